"""A corpus pipeline over documents: each stage is one of the operators of lattica.llm, stored as Parquet for the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm import decontaminate, lines, minhash, packing, quality
from lattica.llm.common import drop_table, fresh, table, tidy

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(c) for c in like.columns])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of at least 0.5). A null or empty text has the score
    of the bias; rows that repeat are each judged."""
    model = quality.learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _columns(quality.score(docs, model).where("score >= 0.5"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one occurrence of each fuzzy line; those that lose all they had go, n_chars follows the text."""
    out = lines.dedup_lines(docs)
    out = out.where((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0))
    n = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    return out.select(*[n if c == "n_chars" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the smallest doc_id; of rows of one doc_id that with the
    smallest hash. Texts without words (null, empty) are classes of their own, one row of each doc_id."""
    root, rank = (fresh(docs, x) for x in ("_root", "_rank"))
    kept = minhash.label_classes(docs, root=root).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    if not kept.groupBy("doc_id").count().where("count > 1").isEmpty():
        # the hash of what tells a class: its root, or the doc_id of a text without words
        of = F.xxhash64(F.coalesce(root, F.lit(0)), F.when(F.col(root).isNull(), F.col("doc_id").cast("string")))
        by = Window.partitionBy(of).orderBy(F.xxhash64(*docs.columns))
        kept = kept.withColumn(rank, F.row_number().over(by)).where(F.col(rank) == 1)
    return _columns(kept, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item's windows, or under a twentieth of their words. Null and empty texts stay,
    and rows that repeat."""
    judged = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _columns(judged.where(~F.col("contaminated")), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 1024 tokens; a null or empty text is one piece of one token."""
    return packing.pack(table(packing.cut_documents(docs), "pieces"))


def tidied(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, which deletes the tables that it wrote and its result does not read."""
    return wraps(stage)(lambda *args: tidy(lambda: stage(*args)))


STAGES = [(stage.__name__, tidied(stage)) for stage in (quality_filter, line_dedup, near_dedup, decontamination, pack)]
#: SQL cannot express the first stage; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again, and then what led to it is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, tidy(lambda: table(stage(spark, docs, sf_dir), name))  # noqa: B023
        drop_table(before)
    return STAGES[-1][1](spark, docs, sf_dir)
