"""Synthetic people and acquaintances, of any size, the same for a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = ("Ada", "Ben", "Cleo", "Dan", "Eve", "Finn", "Gia", "Hugo", "Iris", "Jon", "Kim", "Lea", "Max", "Nia", "Otto", "Pia")
CITIES = ("Northport", "Eastmoor", "Southgate", "Westhill", "Lakeview", "Riverton", "Stonebridge", "Oakfield", "Maplewood", "Harborside")


def _pick(names: tuple, of) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(of, F.lit(len(names))) + 1).cast("int"))


def people(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """name (key), age from 18 to 79, city."""
    h = lambda k: F.xxhash64(F.lit(seed), F.lit(k), "id")
    name = F.concat(_pick(FIRST, F.col("id")), F.lit("-"), F.col("id").cast("string"))
    return spark.range(n).select(name.alias("name"), (F.pmod(h(1), F.lit(62)) + 18).alias("age"), _pick(CITIES, h(2)).alias("city"))


def acquaintances(spark: SparkSession, people_count: int, n: int, seed: int = 42) -> DataFrame:
    """_src, _dst (names of two people), since from 2015 to 2025."""
    h = lambda k: F.xxhash64(F.lit(seed), F.lit(k), "id")
    a = F.pmod(h(3), F.lit(people_count))
    b = F.pmod(a + 1 + F.pmod(h(4), F.lit(max(1, people_count - 1))), F.lit(people_count))
    name = lambda i: F.concat(_pick(FIRST, i), F.lit("-"), i.cast("string"))
    return spark.range(n).select(name(a).alias("_src"), name(b).alias("_dst"), (F.pmod(h(5), F.lit(11)) + 2015).alias("since"))
