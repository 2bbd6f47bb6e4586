"""Connected groups from candidate buckets, without all pairs of a bucket.

``group_buckets`` takes (bucket, node) rows and a way to verify pairs, and returns (node, root) for the groups of
verified links. First each bucket's nodes meet only its head, the node that shares most with others in all its buckets.
What this links is one group. While the pairs across groups outnumber the rows, the nodes of buckets that still hold
several groups meet further heads, drawn by lot, so that a node meets many others but no bucket has more pairs than
some nodes of it. Then the pairs across groups are verified, all of them: pairs inside a group would change nothing, so
no link that matters is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, sized, table, tidy


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the smallest node of its connected group.

    Alternating large-star and small-star steps (Kiveris et al., 2014); each round is a stored table. Rows that repeat,
    loops and empty input are fine.
    """
    now = table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("x"), F.col("m").alias("y")).where("x > y")
        small = small.unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y"))).distinct()
        then = table(small.select(F.col("x").alias("a"), F.col("y").alias("b")), "edges")
        drop_table(now)
        now, after = then, mark(then)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (node, root) after further links (a, b): only links between groups go through the rounds of components."""
    of = lambda k: groups.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
    rooted = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    tops = components(rooted.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    old = groups.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return old.select("node", F.coalesce("top", "root").alias("root")).unionByName(tops.join(groups, "node", "left_anti"))


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def group_buckets(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    sketches: Callable[[DataFrame], DataFrame],
    near: Callable[[str, str], Column],
    star_shared: int = 1,
    heads: int = 6,
    rounds: int = 4,
    slack: int = 2,
    once: Callable[[str, str], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(node, root) of all nodes with a verified link, and the verified links (a, b).

    members: (bucket, node, head), all long: rows of buckets of several nodes, head the first node to try there; without
    head it is found here. verify: from distinct pairs (a, b) the rows that are links. sketches: from (node)
    rows (node, ...), and near(x, y) the condition on the sketches of the rows with the aliases x and y without which a
    pair across groups is no candidate; it stands in the join, so other pairs are never rows. star_shared: in how many
    buckets a node has to meet one head to be tried in the first step, which need not find all; a column weight of members
    says as how many a bucket counts. rounds: how often at
    most mixed buckets try heads drawn by lot, as long as there are more pairs across groups than slack for each row and
    each turn leaves a fifth fewer.
    once: a condition on the rows x and y that holds in just one of the buckets that both are in, where sketches can tell;
    then the last join makes a row for each pair and not for each bucket of it. Tables that members reads are deleted.
    """
    if "head" in members.columns:
        shared, star = members, members
    else:
        size = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        shared = table(members.join(size, "bucket"), "buckets")
        drop_table(members)
        degree = shared.groupBy("node").agg(F.sum("n").alias("degree"))
        head = shared.join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"))).alias("top"))
        star = shared.join(head.select("bucket", (-F.col("top.minus")).alias("head")), "bucket")
    weight = F.sum("weight") if "weight" in star.columns else F.count("*")
    star = star.where("node != head").groupBy(*_pair(F.col("node"), F.col("head"))).agg(weight.alias("n"))
    links = tidy(lambda: table(verify(star.where(F.col("n") >= star_shared).select("a", "b")), "links"))
    groups = tidy(lambda: table(components(links), "groups"))

    def mixed(members: DataFrame) -> DataFrame:
        """members with their roots, of the buckets that hold several."""
        rooted = members.join(sized(groups), "node", "left").withColumn("root", F.coalesce("root", "node"))
        whole = Window.partitionBy("bucket")
        several = rooted.select("*", F.min("root").over(whole).alias("_low"), F.max("root").over(whole).alias("_high"))
        return several.where("_low < _high").drop("_low", "_high")

    def renewed(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
        out = table(new, name)
        drop_table(old)
        return out

    def across(more: Column) -> Column:
        return (F.col("l.bucket") == F.col("r.bucket")) & more & near("l", "r")

    rest = table(mixed(shared.select("bucket", "node")), "mixed")
    drop_table(shared)
    known = tidy(lambda: table(sketches(rest.select("node").distinct()), "sketches"))
    before = math.inf
    for turn in range(rounds + 1):
        of = rest.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inner"))
        rows, left = of.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("inner")) / 2)).first()
        if not left:
            break
        last = turn == rounds or left <= slack * rows or left > 0.8 * before  # lots that linked little are not drawn again
        before = left
        full = rest.join(known, "node")  # not stored: sketches are longer than the rows
        if last:
            met = full.alias("l").join(full.alias("r"), across((F.col("l.root") < F.col("r.root")) & (once("l", "r") if once else F.lit(True))))
        else:
            row = F.struct(*[c for c in full.columns if c != "bucket"])
            lots = [F.min_by(row, F.xxhash64(F.lit(heads * turn + i), "bucket", "node")) for i in range(heads)]
            drawn = full.groupBy("bucket").agg(F.array(*lots).alias("x")).select("bucket", F.explode(F.array_distinct("x")).alias("x")).select("bucket", "x.*")
            met = full.alias("l").join(drawn.alias("r"), across(F.col("l.root") != F.col("r.root")))
        more = tidy(lambda: table(verify(met.select(*_pair(F.col("l.node"), F.col("r.node"))).distinct()), "links"))  # noqa: B023
        if not more.isEmpty():
            links = renewed(links, links.unionByName(more), "links")
            old, groups = groups, tidy(lambda: table(merged(groups, more), "groups"))  # noqa: B023
            drop_table(old)
            rest = rest if last else renewed(rest, mixed(rest.drop("root")), "mixed")
        drop_table(more)
        if last:
            break
    drop_table(rest)
    drop_table(known)
    return groups, links
