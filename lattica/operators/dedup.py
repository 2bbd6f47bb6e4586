"""Row de-duplication by completeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def completeness(df: DataFrame, but: str):
    """How many columns other than one are not null."""
    return reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNotNull().cast("int") for c in df.columns if c != but], F.lit(0))


def dedup_stubs(df: DataFrame, key: str) -> DataFrame:
    """Of rows with equal key only the most complete ones: those with the most columns that are not null. Ties stay."""
    most = Window.partitionBy(key)
    counted = df.withColumn("_n", completeness(df, key))
    return counted.withColumn("_most", F.max("_n").over(most)).where("_n = _most").drop("_n", "_most")


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row per key, a most complete one; ties go to the smallest row."""
    row = F.struct((-completeness(df, key)).alias("_n"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    return df.groupBy(key).agg(F.min(row).alias("_best")).select("_best.row.*")
