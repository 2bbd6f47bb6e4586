"""Graph analytics: shards, cuts, borders, label propagation, migration and co-location plans.

Nodes are DataFrames (key, ...), edges (src, dst, ...); keys are hashed as text.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import shard
from .paths import drop_scratch, scratch_table


def sharded_edges(edges: DataFrame, shards: int) -> DataFrame:
    """edges with the shards of their ends."""
    return edges.withColumns({"src_shard": shard(F.col("src"), shards), "dst_shard": shard(F.col("dst"), shards)})


def cut_edges(edges: DataFrame, shards: int) -> DataFrame:
    """Edges whose ends are on different shards."""
    return sharded_edges(edges, shards).where("src_shard <> dst_shard")


def locality(edges: DataFrame, shards: int) -> DataFrame:
    """The share of edges within a shard; 1 without edges."""
    same = (F.col("src_shard") == F.col("dst_shard")).cast("double")
    return sharded_edges(edges, shards).agg(F.coalesce(F.avg(same), F.lit(1.0)).alias("locality"))


def shard_counts(nodes: DataFrame, shards: int) -> DataFrame:
    return nodes.groupBy(shard(F.col("key"), shards).alias("shard")).agg(F.count("*").alias("nodes"))


def shard_balance(nodes: DataFrame, shards: int) -> DataFrame:
    """The smallest over the largest number of nodes of the shards that hold any; 1 without nodes."""
    return shard_counts(nodes, shards).agg(F.coalesce(F.min("nodes") / F.max("nodes"), F.lit(1.0)).alias("balance"))


def border_nodes(edges: DataFrame, shards: int) -> DataFrame:
    """Distinct (shard, key): ends that an edge of that shard has on another."""
    return cut_edges(edges, shards).select(F.col("src_shard").alias("shard"), F.col("dst").alias("key")).distinct()


def border_counts(edges: DataFrame, shards: int) -> DataFrame:
    return border_nodes(edges, shards).groupBy("shard").agg(F.count("*").alias("border_nodes"))


def border_replicas(edges: DataFrame, nodes: DataFrame, shards: int) -> DataFrame:
    """The border nodes of each shard with all their properties: what a copy beside the edges would hold."""
    return border_nodes(edges, shards).join(nodes, "key")


def approx_shard_sizes(nodes: DataFrame, shards: int, error: float = 0.02) -> DataFrame:
    """Estimated distinct keys by shard, from a sketch."""
    return nodes.groupBy(shard(F.col("key"), shards).alias("shard")).agg(F.approx_count_distinct("key", error).alias("estimate"))


def label_propagation(nodes: DataFrame, edges: DataFrame, shards: int = 4, rounds: int = 10, start: str | None = None) -> DataFrame:
    """(key, label): in each round every node takes the most frequent label of its neighbours, the smallest of ties.

    All nodes change at once, from the labels of the round before. Edges count in both directions, parallel ones and
    loops each time. The first labels are the column start, or else the shards. Nodes without neighbours keep theirs.
    The rounds end when no label changes, or at the given number; each is a stored table.
    """
    spark = nodes.sparkSession
    first = F.col(start) if start else shard(F.col("key"), shards)
    now = scratch_table(nodes.select("key", first.alias("label")).dropDuplicates(["key"]), "labels")
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    # votes by pair of neighbours once, so that rounds move distinct pairs only
    both = scratch_table(both.groupBy("a", "b").agg(F.count("*").alias("w")), "pairs")
    for _ in range(rounds):
        votes = both.join(now.withColumnRenamed("key", "b"), "b").groupBy("a", "label").agg(F.sum("w").alias("votes"))
        best = votes.groupBy("a").agg(F.max(F.struct("votes", (-F.col("label")).alias("least"))).alias("top"))
        best = best.select(F.col("a").alias("key"), (-F.col("top.least")).alias("fresh"))
        then = now.join(best, "key", "left").select("key", F.coalesce("fresh", "label").cast(now.schema["label"].dataType).alias("label"), (F.coalesce("fresh", "label") != F.col("label")).alias("moved"))
        then = scratch_table(then, "labels")
        drop_scratch(spark, now)
        now = then.select("key", "label")
        if then.where("moved").isEmpty():
            break
    return now


@dataclass
class MigrationPlan:
    """moves (key, from_shard, to_shard), and one row of sums."""

    moves: DataFrame
    summary: DataFrame
    communities: DataFrame = field(repr=False, default=None)


def migration_plan(nodes: DataFrame, edges: DataFrame, shards: int = 4, rounds: int = 10, shard_col: str | None = None) -> MigrationPlan:
    """Put communities on shards: by size (the largest first, ties by label), the k-th to shard k mod shards."""
    placed = nodes.select("key", (F.col(shard_col) if shard_col else shard(F.col("key"), shards)).cast("int").alias("from_shard")).dropDuplicates(["key"])
    labels = label_propagation(placed, edges, shards, rounds, "from_shard")
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    ranked = sizes.withColumn("to_shard", ((F.row_number().over(Window.orderBy(F.desc("size"), "label")) - 1) % shards).cast("int"))
    target = placed.join(labels, "key").join(ranked, "label").select("key", "from_shard", "to_shard")
    ends = edges.join(target.select(F.col("key").alias("src"), F.col("from_shard").alias("f1"), F.col("to_shard").alias("t1")), "src", "left").join(target.select(F.col("key").alias("dst"), F.col("from_shard").alias("f2"), F.col("to_shard").alias("t2")), "dst", "left")
    zero = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    cuts = ends.agg(zero(F.col("f1") != F.col("f2")).alias("current_cuts"), zero(F.col("t1") != F.col("t2")).alias("projected_cuts"))
    moves = target.where("from_shard <> to_shard")
    summary = cuts.crossJoin(ranked.agg(F.count("*").alias("communities"))).crossJoin(moves.agg(F.count("*").alias("moves")))
    return MigrationPlan(moves, summary, ranked)


def crossings(steps: DataFrame, top: int | None = None) -> DataFrame:
    """(from_shard, to_shard, crossings), the most frequent first: traversals (from_shard, to_shard) between shards."""
    out = steps.where("from_shard <> to_shard").groupBy("from_shard", "to_shard").agg(F.count("*").alias("crossings")).orderBy(F.desc("crossings"), "from_shard", "to_shard")
    return out if top is None else out.limit(top)


def colocation(steps: DataFrame, primaries: DataFrame, threshold: int, top: int = 100) -> DataFrame:
    """Of the top crossings those of at least threshold whose shards have different primaries (shard, node)."""
    hot = crossings(steps, top).where(F.col("crossings") >= threshold)
    side = lambda s, n: primaries.select(F.col("shard").alias(s), F.col("node").alias(n))
    return hot.join(side("from_shard", "from_node"), "from_shard").join(side("to_shard", "to_node"), "to_shard").where("from_node <> to_node")


def rebalance(assignment: dict[int, tuple[str | None, str | None]], alive: Iterable[str]) -> list[tuple[str, int, str]]:
    """Steps ('primary' | 'replica', shard, node) that give every shard a live primary, level the primaries to within
    one, and give each shard a replica on another live node. assignment: shard -> (primary, replica)."""
    nodes = sorted(set(alive))
    if not nodes:
        return []
    now, steps = dict(assignment), []
    load = {n: sum(p == n for p, _ in now.values()) for n in nodes}

    def lead(s: int, n: str) -> None:
        p, r = now[s]
        if p in load:
            load[p] -= 1
        load[n] += 1
        now[s] = (n, None if r == n else r)
        steps.append(("primary", s, n))

    for s in sorted(now):
        p, r = now[s]
        if p not in load:
            lead(s, r if r in load else min(nodes, key=lambda n: (load[n], n)))
    while max(load.values()) - min(load.values()) > 1:
        most, least = max(nodes, key=lambda n: (load[n], n)), min(nodes, key=lambda n: (load[n], n))
        lead(min(s for s in now if now[s][0] == most), least)
    copies = {n: sum(r == n for _, r in now.values()) for n in nodes}
    for s in sorted(now):
        p, r = now[s]
        if (r not in load or r == p) and len(nodes) > 1:
            n = min((x for x in nodes if x != p), key=lambda x: (copies[x], x))
            copies[n] += 1
            now[s] = (p, n)
            steps.append(("replica", s, n))
    return steps
