"""FNV-1a hashes of batches of texts: 32 bits for shards, 64 bits for identities."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

OFFSET_32, PRIME_32 = 0x811C9DC5, 16777619
OFFSET_64, PRIME_64 = 0xCBF29CE484222325, 0x100000001B3


def _hashes(texts: pd.Series, offset: int, prime: int, mask: int) -> pd.Series:
    """FNV-1a of the UTF-8 bytes of all texts at once, byte position by byte position; null for null."""
    column = pa.array(texts, pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")  # those that still have bytes come first
    begin, size = at[:-1][order], size[order]
    h = np.full(len(column), offset, np.uint64)
    left = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
    with np.errstate(over="ignore"):
        for j, n in enumerate(left):
            h[:n] = ((h[:n] ^ data[begin[:n] + j]) * np.uint64(prime)) & np.uint64(mask)
    out = np.empty(len(column), np.int64)
    out[order] = (h & np.uint64(0x7FFFFFFFFFFFFFFF)).view(np.int64)
    return pd.Series(out, index=texts.index, dtype="Int64").mask(texts.isna())


@pandas_udf(LongType())
def _hash32(texts: pd.Series) -> pd.Series:
    return _hashes(texts, OFFSET_32, PRIME_32, 0xFFFFFFFF)


def fnv1a32(key: Column) -> Column:
    """The 32-bit FNV-1a hash of the key as text (UTF-8 bytes), as a long; null for null."""
    return _hash32(key.cast("string"))


def shard(key: Column, shards: int) -> Column:
    """The shard of a key: its hash modulo the number of shards."""
    return (fnv1a32(key) % shards).cast("int")


def fnv1a64(data: bytes) -> int:
    h = OFFSET_64
    for b in data:
        h = ((h ^ b) * PRIME_64) & 0xFFFFFFFFFFFFFFFF
    return h


@pandas_udf(LongType())
def _id(joined: pd.Series) -> pd.Series:
    return _hashes(joined, OFFSET_64, PRIME_64, 0xFFFFFFFFFFFFFFFF)


def node_id(label: Column, key: Column) -> Column:
    """A stable positive 63-bit identity of a node."""
    return _id(F.concat(label, F.lit("\0"), key.cast("string")))


def rel_id(kind: Column, src: Column, dst: Column) -> Column:
    """A stable positive 63-bit identity of a relationship."""
    return _id(F.concat(kind, F.lit("\0"), src.cast("string"), F.lit("\0"), dst.cast("string")))
