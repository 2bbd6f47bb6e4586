"""Words are cut without regular expressions, and are those that these give."""

import re

from pyspark.sql import functions as F

from lattica.llm import decontaminate, pitman_yor

ODD = [None, "", " ", "Ab c", "\x00a\x7fB\x1f", "ÄB éÉ\u0130I", "a_b-c.d", "\u3000x\u00a0Y", "\U00010400Z \U0001f600!q", "\n\r\v\fW\t0", "ΑΣ ς1", "[`{@/:", "x" * 3000 + " y" * 3000]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_those_of_the_expressions(spark):
    df = spark.createDataFrame([(x,) for x in ODD], "text string")
    for words, pattern, end in ((decontaminate.words, "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", []), (pitman_yor.words, "[^\\x20\\x09-\\x0D]+", ["\n"])):
        got = df.select(words(F.col("text")).alias("w"))
        lower = [re.sub("[A-Z]", lambda m: m[0].lower(), x or "") for x in ODD]
        assert [r.w for r in got.collect()] == [re.findall(pattern, x) + end for x in lower]
        assert "regexp" not in plan(got)
