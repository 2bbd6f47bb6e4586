"""Bloom filters of keys by shard, as bit positions in a DataFrame."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import shard


def sizes(expected: int, rate: float) -> tuple[int, int]:
    """Bits, rounded up to words of 64, and hash functions (at most 30) for so many keys and false positives."""
    m = -(-math.ceil(-max(1, expected) * math.log(rate) / math.log(2) ** 2) // 64) * 64
    return m, min(30, max(1, round(m / max(1, expected) * math.log(2))))


def _positions(key, m: int, k: int):
    a, b = F.xxhash64(key), F.xxhash64(F.lit(0x9E), key)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(F.pmod(a, F.lit(m)) + i * F.pmod(b, F.lit(m)), F.lit(m)))


def build(keys: DataFrame, shards: int, m: int, k: int) -> DataFrame:
    """(shard, word, bits): the words of 64 positions that keys (key) set in the filter of their shard."""
    at = keys.select(shard(F.col("key"), shards).alias("shard"), F.explode(_positions(F.col("key"), m, k)).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))
    return at.groupBy("shard", F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))


def likely_shards(filters: DataFrame, keys: DataFrame, m: int, k: int) -> DataFrame:
    """(key, shard) of all shards that may hold the key: no shard that does is missing."""
    probes = keys.select("key", F.explode(_positions(F.col("key"), m, k)).alias("p")).distinct()
    probes = probes.select("key", F.floor(F.col("p") / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int")).alias("bit"), "p")
    wanted = probes.groupBy("key").agg(F.count("*").alias("n"))
    hit = probes.join(filters, "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0).groupBy("key", "shard").agg(F.count("*").alias("n"))
    return hit.join(wanted, ["key", "n"]).select("key", "shard")


def estimate(filters: DataFrame, m: int, k: int) -> DataFrame:
    """(shard, keys): the number of keys that so many set bits suggest."""
    x = F.sum(F.bit_count("bits"))
    return filters.groupBy("shard").agg((-m / k * F.log(1 - x / m)).alias("keys"))
