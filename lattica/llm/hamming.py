"""Exact top-k search of binary codes by incremental multi-index hashing (Norouzi, Punjani and Fleet, 2012).

Vectors become sign codes. Distinct codes are dealt to blocks; inside a block each of m segments of the codes has a
table from segment value to codes. A query probes the tables in order of segment radius r = 0, 1, 2...: once radius r
is done for segments 0..j (and r - 1 for the rest), every code within m*r + j bits has been seen, so the search ends
as soon as the k-th verified distance is no larger.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row (id, code) per id: bit i of the code says that component i is over 0. Null and empty vectors have none.

    A null component counts as 0, and so do those that pad a code to whole bytes; only codes of equally many bytes meet. Of an id that repeats with other vectors the smallest code stays.
    """
    prepare(vectors.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("code", pa.binary())])

    def run(batches):
        for b in batches:
            flat, n = b.column(1), np.diff(b.column(1).offsets.to_numpy())
            values = np.nan_to_num(flat.flatten().to_numpy(zero_copy_only=False).astype("f4")) > 0
            out, at = [], 0
            if len(n) and (n == n[0]).all():
                packed = np.packbits(values.reshape(len(n), -1), axis=1)
                out = [x.tobytes() for x in packed]
            else:
                for k in n:
                    out.append(np.packbits(values[at : at + k]).tobytes())
                    at += k
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(out, pa.binary())], schema=schema)

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0))
    return rows.mapInArrow(run, "id long, code binary").groupBy("id").agg(F.min("code").alias("code"))


class Index:
    """Segment tables over distinct codes of equal length (uint8 rows); weights say how many ids a code stands for."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray):
        self.bits = np.unpackbits(codes, axis=1)
        self.n, d = self.bits.shape
        self.weights = weights
        size = max(4, min(16, int(np.log2(max(2, self.n)))))
        self.m = max(1, round(d / size))
        self.cuts = [(d * j // self.m, d * (j + 1) // self.m) for j in range(self.m)]
        pad = -codes.shape[1] % 8
        self.words = np.pad(codes, ((0, 0), (0, pad))).view(np.uint64)
        self.tables = []
        for a, b in self.cuts:
            v = self.value(self.bits, a, b)
            order = np.argsort(v, kind="stable")
            self.tables.append((order, np.searchsorted(v[order], np.arange((1 << (b - a)) + 1))))
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def value(bits: np.ndarray, a: int, b: int) -> np.ndarray:
        return bits[..., a:b].astype(np.int64) @ (1 << np.arange(b - a - 1, -1, -1, dtype=np.int64))

    def mask(self, width: int, r: int) -> np.ndarray:
        if (width, r) not in self.masks:
            self.masks[width, r] = np.array([sum(1 << i for i in c) for c in combinations(range(width), r)], np.int64)
        return self.masks[width, r]

    def search(self, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of all codes as near as the k-th id, the k ids being the nearest."""
        bits = np.unpackbits(code)
        word = np.pad(code, (0, -len(code) % 8)).view(np.uint64)
        seen = np.zeros(self.n, bool)
        within = np.zeros(len(bits) + 1, np.int64)  # ids by distance
        found, dist = [], []
        k = min(k, int(self.weights.sum()))
        for r in range(max(b - a for a, b in self.cuts) + 1):
            for j, (a, b) in enumerate(self.cuts):
                if r <= b - a:
                    order, start = self.tables[j]
                    probe = self.value(bits, a, b) ^ self.mask(b - a, r)
                    lo, n = start[probe], start[probe + 1] - start[probe]
                    lo, n = lo[n > 0], n[n > 0]
                    if len(n):
                        at = order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
                        at = at[~seen[at]]
                        seen[at] = True
                        d = np.bitwise_count(self.words[at] ^ word).sum(axis=1).astype(np.int64)
                        found.append(at)
                        dist.append(d)
                        np.add.at(within, d, self.weights[at])
                if within[: self.m * r + j + 1].sum() >= k:
                    at, d = np.concatenate(found), np.concatenate(dist)
                    last = np.searchsorted(np.cumsum(within), k)
                    return at[d <= last], d[d <= last]
        return (np.concatenate(found), np.concatenate(dist)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block_codes: int = 65_536, query_codes: int = 256) -> DataFrame:
    """The k nearest other ids of each query by Hamming distance of sign codes: query_id, rank, vec_id, distance.

    Ties go to the smaller id. is_query is a condition on the column id. Fewer than k rows come back where there are
    fewer other vectors of the query's length. Equal codes are searched once, and each code keeps its k + 1 smallest ids (a query itself
    may be one of them), so a code that a third of the rows share is no burden and no answer is lost.
    """
    codes = sign_codes(vectors, id_col, vector_col)
    near = Window.partitionBy("code").orderBy("id")
    few = codes.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1)
    distinct = few.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    asked = codes.where(is_query)
    counts = distinct.agg(F.count("*")).first()[0], asked.select("code").distinct().count()
    blocks, groups = (max(1, -(-n // size)) for n, size in zip(counts, (block_codes, query_codes)))
    deal = lambda n: F.pmod(F.xxhash64("code"), F.lit(n)).cast("int")
    stored = distinct.groupBy(deal(blocks).alias("block"), F.length("code").alias("bytes")).agg(F.collect_list(F.struct("code", "ids")).alias("held"))
    wanted = asked.select("code").distinct().groupBy(deal(groups).alias("group"), F.length("code").alias("bytes")).agg(F.collect_list("code").alias("wanted"))
    pairs = stored.join(wanted.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), ["block", "bytes"]).repartition(F.col("block"), F.col("group"))
    schema = pa.schema([("code", pa.binary()), ("near", pa.list_(pa.struct([("distance", pa.int32()), ("vec_id", pa.int64())])))])

    def run(batches):
        for b in batches:
            for held, wanted in zip(b.column("held").to_pylist(), b.column("wanted").to_pylist()):
                ids = [x["ids"] for x in held]
                index = Index(np.frombuffer(b"".join(x["code"] for x in held), np.uint8).reshape(len(held), -1), np.array([len(x) for x in ids]))
                out = []
                for code in wanted:
                    at, d = index.search(np.frombuffer(code, np.uint8), k + 1)
                    out.append([{"distance": x, "vec_id": y} for x, y in sorted((int(x), y) for a, x in zip(at, d) for y in ids[a])[: k + 1]])
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.binary()), pa.array(out, schema.field(1).type)], schema=schema)

    lists = pairs.select("held", "wanted").mapInArrow(run, "code binary, near array<struct<distance:int,vec_id:long>>")
    best = lists.groupBy("code").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    own = F.filter("near", lambda x: x["vec_id"] != F.col("id"))
    ranked = asked.join(best, "code").select(F.col("id").alias("query_id"), F.posexplode(F.slice(own, 1, k)).alias("rank", "hit"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.distance").alias("distance"))


def op9_hamming_topk(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest of each vector whose id 20 divides, among all embeddings."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0, 10)


ORACLE = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x > 0 AS INTEGER)) AS b FROM embeddings),
d AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(q.b, c.b), lambda p: CAST(p[1] <> p[2] AS INTEGER))) AS INTEGER) AS distance
      FROM c q JOIN c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
