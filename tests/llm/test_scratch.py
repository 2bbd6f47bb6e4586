import corpus_pipeline
from lattica.llm import common


def folders(spark):
    """Names of the tables in the scratch folder."""
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{common.scratch(spark).rstrip('/')}/lattica")
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    return {x.getPath().getName() for x in fs.listStatus(base)} if fs.exists(base) else set()


def test_tidy_keeps_what_is_read(spark):
    before = folders(spark)

    def make():
        common.table(spark.range(3), "first")
        second = common.table(spark.range(4).withColumnRenamed("id", "k"), "second")
        return second.join(common.table(spark.range(5).withColumnRenamed("id", "k"), "third"), "k")

    out = common.tidy(make)
    assert {x.partition("-")[0] for x in folders(spark) - before} == {"second", "third"} and out.count() == 4
    common.drop_table(out)
    assert folders(spark) == before


def test_operators_leave_little(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = folders(spark)
    corpus_pipeline.STAGES[1][1](spark, docs, sf)
    assert {x.partition("-")[0] for x in folders(spark) - before} == {"gone"}
    before = folders(spark)
    corpus_pipeline.STAGES[2][1](spark, docs, sf)
    assert {x.partition("-")[0] for x in folders(spark) - before} == {"labels"}
    before = folders(spark)
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert {x.partition("-")[0] for x in folders(spark) - before} <= {"decontamination", "pieces", "lengths"}
