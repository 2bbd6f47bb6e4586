"""The terms of blocks of lines are those of each line, cut once."""

from pyspark.sql import functions as F

from lattica.llm import licenses

from .test_word_cuts import plan


def test_spans_cut_each_line_once(spark):
    lines = ["Licensed under the MIT.", "License 2.0", ".5 ΑΣ", "Σ", "", "in 3.", "4 Ä"] * 4
    df = spark.createDataFrame([(1, 0, lines), (2, 5, lines[:3]), (3, 1, lines[:1])], "file_key long, unit int, ls array<string>")
    got = licenses.spans_of(df)
    want = df.select("file_key", F.explode(F.array(*[F.lit(k) for k in licenses.SPANS])).alias("k"), "ls").where("k <= size(ls)")
    want = want.select("file_key", "k", licenses.terms(F.array_join(F.slice("ls", 1, F.col("k")), "\n")).alias("t"))
    assert {(r.file_key, r.span, *r.t) for r in got.collect()} == {(r.file_key, r.k, *r.t) for r in want.collect()}
    assert plan(got).count("regexp_extract_all") == 1
