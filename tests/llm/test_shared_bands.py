import random

from pyspark.sql import functions as F

from lattica.llm import common, linkage, minhash


def test_pairs_that_share_many_buckets_are_one_row(spark):
    """Of two texts' common bands one is the first, whatever others they share."""
    rng = random.Random(5)
    a = [rng.randrange(1 << 60) for _ in range(8)]
    rows = []
    for share in ([0, 3, 7], [2], [5, 6], []):
        b = [x if i in share else rng.randrange(1 << 60) for i, x in enumerate(a)]
        rows += [(*a, *b, x, len(share)) for x in {*a} & {*b}]
    df = spark.createDataFrame(rows, ", ".join(f"{s}{i} long" for s in "ab" for i in range(8)) + ", bucket long, n int")
    first = minhash.first_shared([df[f"a{i}"] for i in range(8)], [df[f"b{i}"] for i in range(8)], df.bucket)
    assert {r.n: r["count"] for r in df.where(first).groupBy("n").count().collect()} == {3: 1, 1: 1, 2: 1}


def test_groups_with_a_row_for_each_pair(spark):
    """Two nodes in 5 buckets, which no head links: the last join finds them, once."""
    nodes = {1: [10, 11, 12, 13, 14], 2: [10, 11, 12, 13, 14], 3: [14, 20, 21, 22, 23]}
    bands = spark.createDataFrame([(k, *v) for k, v in nodes.items()], "node long, " + ", ".join(f"b{i} long" for i in range(5)))
    members = common.table(bands.select(F.explode(F.array(*[f"b{i}" for i in range(5)])).alias("bucket"), "node"), "members")
    of = lambda k: [F.col(f"{k}.b{i}") for i in range(5)]
    asked = []

    def verify(pairs):
        asked.append(sorted(map(tuple, pairs.collect())))
        return pairs.where("a = 1 AND b = 2") if len(asked) > 1 else pairs.limit(0)

    once = lambda x, y: minhash.first_shared(of(x), of(y), F.col(f"{x}.bucket"))
    groups, _ = linkage.group_buckets(members, verify, lambda some: bands.join(some, "node", "left_semi"), lambda x, y: F.lit(True), once=once, slack=9)
    assert {(r.node, r.root) for r in groups.collect()} == {(1, 1), (2, 1)} and (1, 2) in asked[-1]
