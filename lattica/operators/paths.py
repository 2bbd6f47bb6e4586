"""Paths over an edge DataFrame (_from, _to, ...): walks, reachable sets, shortest lengths, all in rounds of joins."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hops of single walks without an upper bound (reachable sets and shortest paths have none), and rounds between stored tables.
MOST_HOPS, STORE = 30, 5
#: No bound: the rounds end when nothing new is reached.
ENDLESS = 2**31 - 1
#: So many pairs at most are searched for from both ends; their answers are rows on the driver.
FEW = 1_000


def scratch_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: spark.checkpoint.dir, which only a local master may leave unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        base = "file://" + tempfile.mkdtemp(prefix="lattica-", dir="/tmp/checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lattica"


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """df as a stored table in the shared folder, which cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, df: DataFrame) -> None:
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def walks(starts: DataFrame, edges: DataFrame, low: int, high: int, keep_nodes: bool = False, trail: bool = False) -> DataFrame:
    """Every walk of low..high edges from starts (_start): _start, _end, _len, and _nodes if asked for.

    trail leaves out walks that use an edge twice; edges then need _eid.
    """
    now = starts.select("_start", F.col("_start").alias("_end"), *([F.array("_start").alias("_nodes")] if keep_nodes else []), *([F.array().cast("array<long>").alias("_eids")] if trail else []))
    out = [now.withColumn("_len", F.lit(0))] if low == 0 else []
    for k in range(1, high + 1):
        step = now.join(edges, F.col("_end") == F.col("_from"))
        if trail:
            step = step.where(~F.array_contains("_eids", F.col("_eid")))
        now = step.select(
            "_start", F.col("_to").alias("_end"), *([F.array_append("_nodes", F.col("_to")).alias("_nodes")] if keep_nodes else []),
            *([F.array_append("_eids", F.col("_eid")).alias("_eids")] if trail else []),
        )
        if k >= low:
            out.append(now.withColumn("_len", F.lit(k)))
    return reduce(DataFrame.unionByName, out).drop("_eids")


def reachable(starts: DataFrame, edges: DataFrame, low: int, high: int | None) -> DataFrame:
    """Distinct (_start, _end) of walks of low..high edges: the frontier is a set in each round, so work grows with the
    number of nodes and not of walks. Without high, all that is reached after low edges, until nothing new is."""
    step = edges.select("_from", "_to")
    now = starts.select("_start", F.col("_start").alias("_end")).distinct()
    out = [now] if low == 0 else []
    for k in range(1, (low if high is None else high) + 1):
        now = now.join(step, F.col("_end") == F.col("_from")).select("_start", F.col("_to").alias("_end")).distinct()
        if k >= low:
            out.append(now)
    if high is None:
        return _spread(now, edges, 0, ENDLESS, None).select("_start", "_end")
    return reduce(DataFrame.unionByName, out).distinct()


def frontier_hops(keys: DataFrame, hops: list[DataFrame]) -> DataFrame:
    """The distinct keys (_key) after following one edge DataFrame after the other."""
    now = keys.select("_key").distinct()
    for edges in hops:
        now = edges.select("_from", "_to").join(now, F.col("_from") == F.col("_key"), "left_semi").select(F.col("_to").alias("_key")).distinct()
    return now


def between(pairs: DataFrame, edges: DataFrame, high: int) -> DataFrame:
    """_start, _end, _len for the pairs (_start, _end, not equal) with a walk of at most high edges.

    Both ends send out a frontier; each round the smaller one goes a step on, so neither grows to the whole graph as
    long as they can meet before. A pair is found in the round in which its frontiers first meet, and its length is the
    number of rounds.
    """
    kept = [edges.select("_from", "_to").distinct().persist(StorageLevel.MEMORY_AND_DISK)]
    ahead = kept[0].select(F.col("_from").alias("_at"), "_to")
    back = kept[0].select(F.col("_to").alias("_at"), F.col("_from").alias("_to"))
    sides = []
    for end, step in (("_start", ahead), ("_end", back)):
        first = pairs.select(end, F.col(end).alias("_at")).distinct()
        sides.append({"end": end, "step": step, "front": first, "seen": first, "n": first.count()})
    open_, found = pairs.select("_start", "_end").distinct(), []
    spark = pairs.sparkSession
    for k in range(1, high + 1):
        if not all(s["n"] for s in sides):
            break
        s, other = sides if sides[0]["n"] <= sides[1]["n"] else sides[::-1]
        front = F.broadcast(s["front"]) if s["n"] <= FEW * 100 else s["front"]  # counted rows of two keys
        new = front.join(s["step"], "_at").select(s["end"], F.col("_to").alias("_at")).distinct()
        new = new.join(s["seen"], [s["end"], "_at"], "left_anti").persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(new)
        s["n"] = new.count()
        s["front"], s["seen"] = new, s["seen"].unionByName(new)
        met = new.join(other["seen"], "_at").join(open_, ["_start", "_end"]).select("_start", "_end").distinct().collect()
        if met:
            found += [(*r, k) for r in met]
            rows = spark.createDataFrame(met, pairs.select("_start", "_end").schema)
            open_ = open_.join(F.broadcast(rows), ["_start", "_end"], "left_anti")
            if open_.isEmpty():
                break
        if k % STORE == 0:
            for x in sides:
                x["seen"] = scratch_table(x["seen"], "seen")
                x["front"] = scratch_table(x["front"], "front")
    for x in kept:
        x.unpersist()
    schema = T.StructType([*pairs.select("_start", "_end").schema, T.StructField("_len", T.IntegerType())])
    return spark.createDataFrame(found, schema)


def shortest_lengths(starts: DataFrame, edges: DataFrame, low: int, high: int, targets: DataFrame | None = None) -> DataFrame:
    """_start, _end, _len: the fewest edges of a walk of at least low (0 or 1) and at most high edges.

    A round extends only pairs that the round before has found first, and is one job: its pairs are kept (in memory, on
    disk beyond it, made again if an executor goes) and counted, with those of targets (_start, _end) among them. The
    rounds end when nothing new is reached or no target is missing. Every STORE rounds the pairs so far become a
    stored table, which cuts the lineage. A few targets are searched for from both ends (see between).
    """
    if targets is not None and (few := targets.select("_start", "_end").distinct().limit(FEW + 1).collect()) and len(few) <= FEW:
        loops = [r for r in few if r[0] == r[1]]  # a loop has an end that is its start: search it from one side
        apart = starts.sparkSession.createDataFrame([r for r in few if r[0] != r[1]], targets.select("_start", "_end").schema)
        found = between(apart, edges, high)
        if not loops:
            return found
        starts = starts.sparkSession.createDataFrame([(r[0],) for r in loops], targets.select("_start").schema)
        targets = starts.select("_start", F.col("_start").alias("_end"))
        return found.unionByName(_from_starts(starts, edges, low, high, targets))
    return _from_starts(starts, edges, low, high, targets)


def _from_starts(starts: DataFrame, edges: DataFrame, low: int, high: int, targets: DataFrame | None) -> DataFrame:
    """shortest_lengths from the starts alone."""
    return _spread(starts.select("_start", F.col("_start").alias("_end")).distinct(), edges, low, high, targets)


def _spread(pairs: DataFrame, edges: DataFrame, low: int, high: int, targets: DataFrame | None) -> DataFrame:
    """_start, _end, _len: what the distinct pairs (_start, _end) reach by low..high further edges, and by how few."""
    step = edges.select("_from", "_to").distinct()
    wanted = None if targets is None else targets.select("_start", "_end").distinct().withColumn("_hit", F.lit(1)).persist()
    missing = -1 if wanted is None else wanted.count()
    frontier, stored = pairs.withColumn("_len", F.lit(0)), None
    layers, held = [frontier] if low == 0 else [], []
    for k in range(1, high + 1):
        new = frontier.join(step, F.col("_end") == F.col("_from")).select("_start", F.col("_to").alias("_end")).distinct()
        if layers:
            new = new.join(reduce(DataFrame.unionByName, layers), ["_start", "_end"], "left_anti")
        frontier = new.withColumn("_len", F.lit(k)).persist(StorageLevel.MEMORY_AND_DISK)
        counted = frontier if wanted is None else frontier.join(wanted, ["_start", "_end"], "left")
        n, hits = counted.agg(F.count("*"), F.lit(0) if wanted is None else F.count("_hit")).first()
        layers.append(frontier)
        held.append(frontier)
        missing -= hits
        if not n or missing == 0:
            break
        if k % STORE == 0:
            old, stored = stored, scratch_table(reduce(DataFrame.unionByName, layers), "hops")
            layers, frontier = [stored], stored.where(F.col("_len") == k)
            while held:
                held.pop().unpersist()
            if old is not None:
                drop_scratch(edges.sparkSession, old)
    out = scratch_table(reduce(DataFrame.unionByName, layers), "hops")
    for layer in held:
        layer.unpersist()
    if stored is not None:
        drop_scratch(edges.sparkSession, stored)
    return out if wanted is None else out.join(wanted, ["_start", "_end"], "left_semi")


def all_shortest(starts: DataFrame, edges: DataFrame, low: int, high: int, targets: DataFrame | None = None) -> DataFrame:
    """One row for every shortest walk: _start, _end, _len, _nodes. Walks grow only along shortest prefixes."""
    lengths = shortest_lengths(starts, edges, low, high, None if targets is None else targets)
    every = lengths if targets is None else shortest_lengths(starts, edges, low, high)
    every = scratch_table(every, "hops")
    most = every.agg(F.max("_len")).first()[0] or 0
    now = starts.select("_start", F.col("_start").alias("_end"), F.array("_start").alias("_nodes")).distinct()
    out = [now.withColumn("_len", F.lit(0)).join(every, ["_start", "_end", "_len"], "left_semi")]
    for k in range(1, most + 1):
        now = now.join(edges, F.col("_end") == F.col("_from")).select("_start", F.col("_to").alias("_end"), F.array_append("_nodes", F.col("_to")).alias("_nodes"))
        now = now.join(every.where(F.col("_len") == k), ["_start", "_end"], "left_semi")
        out.append(now.withColumn("_len", F.lit(k)))
    got = reduce(DataFrame.unionByName, out)
    return got if targets is None else got.join(targets.select("_start", "_end").distinct(), ["_start", "_end"], "left_semi")
