import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from lattica.engine import Engine
from lattica.errors import QueryError
from lattica.functions.hashing import fnv1a32, fnv1a64, node_id
from lattica.operators import analytics, bloom, paths
from lattica.operators.dedup import dedup_stubs
from lattica.sources import csv_io, generate, snapshot
from lattica.streaming.changelog import ChangeLog, lag
from lattica.streaming.ingest import IngestQueue


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_hashes(spark):
    df = spark.createDataFrame([("",), ("a",), ("foobar",), ("é",), (None,)], "k string")
    got = [r[0] for r in df.select(fnv1a32(F.col("k"))).collect()]
    h = 0x811C9DC5
    for b in "é".encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    assert got == [0x811C9DC5, 0xE40C292C, 0xBF9CF968, h, None]
    assert [r[0] for r in df.limit(2).select(node_id(F.lit("P"), F.col("k"))).collect()] == [fnv1a64(b"P\0") & (1 << 63) - 1, fnv1a64(b"P\0a") & (1 << 63) - 1]


def test_dedup_stubs(spark):
    df = spark.createDataFrame([("Bob", None, None), ("Alice", 30, "Auckland"), ("Bob", 25, "Wellington")], "name string, age int, city string")
    assert rows(dedup_stubs(df, "name")) == [("Alice", 30, "Auckland"), ("Bob", 25, "Wellington")]
    assert dedup_stubs(df.limit(0), "name").count() == 0


def graph(spark, nodes, edges):
    return spark.createDataFrame(nodes, "key string, shard int"), spark.createDataFrame(edges, "src string, dst string")


def test_communities(spark):
    one = graph(spark, [("A", 0), ("B", 0), ("C", 1)], [("A", "B"), ("B", "C"), ("A", "C")])
    assert len({r[1] for r in analytics.label_propagation(*one, start="shard").collect()}) == 1
    nodes = [(k, 0) for k in "ABCG"] + [(k, 1) for k in "DEF"]
    edges = [("A", "B"), ("B", "C"), ("A", "C"), ("D", "E"), ("E", "F"), ("D", "F"), ("G", "D"), ("G", "E"), ("G", "F")]
    plan = analytics.migration_plan(*graph(spark, nodes, edges), shards=2, shard_col="shard")
    s = plan.summary.first()
    assert (s.current_cuts, s.communities) == (3, 2) and s.projected_cuts <= 3
    empty = analytics.migration_plan(*graph(spark, [], []), shards=2, shard_col="shard")
    assert tuple(empty.summary.first()) == (0, 0, 0, 0)
    assert analytics.locality(graph(spark, [], [])[1], 3).first()[0] == 1.0


def test_label_propagation_random(spark):
    rng = random.Random(5)
    keys = [f"n{i}" for i in range(40)]
    edges = [(rng.choice(keys), rng.choice(keys)) for _ in range(70)]
    label = {k: i % 4 for i, k in enumerate(keys)}
    nodes = list(label.items())
    for _ in range(3):
        votes = {k: Counter() for k in keys}
        for a, b in edges:
            votes[a][label[b]] += 1
            votes[b][label[a]] += 1
        label = {k: min(v, key=lambda x: (-v[x], x)) if v else label[k] for k, v in votes.items()}
    assert dict(rows(analytics.label_propagation(*graph(spark, nodes, edges), rounds=3, start="shard"))) == label


def test_crossings(spark):
    df = spark.createDataFrame([(0, 1)] * 3 + [(1, 2), (2, 2)], "from_shard int, to_shard int")
    assert [tuple(r) for r in analytics.crossings(df, 5).collect()] == [(0, 1, 3), (1, 2, 1)]
    primaries = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b")], "shard int, node string")
    assert [(r.from_shard, r.to_shard, r.crossings) for r in analytics.colocation(df, primaries, 1).collect()] == [(0, 1, 3)]
    steps = analytics.rebalance({0: ("dead", "a"), 1: ("a", None), 2: ("a", "b")}, ["a", "b"])
    now = {0: ["dead", "a"], 1: ["a", None], 2: ["a", "b"]}
    for kind, s, n in steps:
        now[s][kind == "replica"] = n
    assert {p for p, _ in now.values()} == {"a", "b"} and all(p != r for p, r in now.values())


def test_bloom(spark):
    keys = spark.range(5000).select(F.concat(F.lit("key-"), F.col("id")).alias("key"))
    m, k = bloom.sizes(5000, 0.01)
    f = bloom.build(keys, 1, m, k)
    assert bloom.likely_shards(f, keys, m, k).count() == 5000
    assert abs(bloom.estimate(f, m, k).first()["keys"] - 5000) < 1000
    other = spark.range(5000).select(F.concat(F.lit("no-"), F.col("id")).alias("key"))
    assert bloom.likely_shards(f, other, m, k).count() < 150


def test_random_paths(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(25), rng.randrange(25)) for _ in range(45)]
    df = spark.createDataFrame(edges, "_from long, _to long")
    starts = spark.createDataFrame([(0,), (7,)], "_start long")
    want = {}
    for s in (0, 7):
        seen, todo = {}, deque([(s, 0)])
        while todo:
            n, d = todo.popleft()
            for a, b in edges:
                if a == n and b not in seen and d < 8:
                    seen[b] = d + 1
                    todo.append((b, d + 1))
        want |= {(s, n, d) for n, d in seen.items()} if isinstance(want, set) else {(s, n): d for n, d in seen.items()}
    got = {(a, b): c for a, b, c in rows(paths.shortest_lengths(starts, df, 1, 8).select("_start", "_end", "_len"))}
    assert got == want
    walks = Counter((a, b) for a, b, _ in rows(paths.walks(starts, df, 1, 3).select("_start", "_end", "_len")))
    assert set(walks) == set(rows(paths.reachable(starts, df, 1, 3)))


@pytest.fixture
def people(spark):
    e = Engine(spark)
    e.cypher("CREATE NODE TABLE Person(name STRING, age INT64, PRIMARY KEY(name))")
    e.cypher("CREATE REL TABLE KNOWS(FROM Person TO Person, since INT64)")
    return e


def test_csv(people, tmp_path):
    g = people.graph
    bad = tmp_path / "bad.csv"
    bad.write_text("name,age\nA,1\nB\nC,x\nD,4,5\nE,5\n")
    with pytest.raises(QueryError):
        csv_io.load_nodes(g, "Person", str(bad))
    got = csv_io.load_nodes(g, "Person", str(bad), strict=False)
    assert (got.loaded, got.errors) == (2, 3)
    assert rows(people.cypher("MATCH (p:Person) RETURN p.name AS n, p.age AS a")) == [("A", 1), ("E", 5)]
    nokey = tmp_path / "nokey.csv"
    nokey.write_text("age\n1\n")
    with pytest.raises(QueryError):
        csv_io.load_nodes(g, "Person", str(nokey))
    edges = tmp_path / "edges.csv"
    edges.write_text("from,to,since\nA,E,2020\nA,Z,2021\nA,E,2019\n")
    csv_io.load_edges(g, "KNOWS", str(edges))
    assert rows(csv_io.missing_ends(g, "KNOWS")) == [("dst", "Z")]
    assert rows(csv_io.export_edges(g, "KNOWS")) == [("A", "E", 2019), ("A", "Z", 2021)]
    assert csv_io.export_edges(g, "KNOWS", keep_parallel=True).count() == 3
    assert csv_io.export_nodes(g, "Person").columns == ["age", "name"]


def test_statements_and_snapshot(people, spark, tmp_path):
    people.cypher("CREATE (p:Person {name: 'O\\'Hara \\\\ x', age: 3})")
    people.cypher("CREATE (p:Person {name: 'B'})")
    again = Engine(spark)
    again.cypher("CREATE NODE TABLE Person(name STRING, age INT64, PRIMARY KEY(name))")
    for r in csv_io.to_statements(people.graph, "Person").collect():
        again.cypher(r[0])
    assert rows(again.graph.node("Person").df) == rows(people.graph.node("Person").df)
    at = [snapshot.save(people.graph, f"file://{tmp_path}/s", 3, 9) for _ in range(2)]
    assert [p.rpartition("/")[2] for p in snapshot.snapshots(spark, f"file://{tmp_path}/s")] == [p.rpartition("/")[2] for p in reversed(at)]
    back = Engine(spark)
    assert snapshot.restore(back.graph, at[0])["wal_sequence"] == 9
    assert rows(back.graph.node("Person").df) == rows(people.graph.node("Person").df)
    assert len(snapshot.retain(spark, f"file://{tmp_path}/s", 1)) == 1


def test_generated(spark):
    p, k = generate.people(spark, 100), generate.acquaintances(spark, 100, 300)
    assert p.select("name").distinct().count() == 100 and k.where("_src = _dst").count() == 0
    assert k.join(p, k["_src"] == p["name"], "left_anti").count() == 0
    assert rows(generate.people(spark, 10)) == rows(generate.people(spark, 10))


def test_ingest(spark, tmp_path):
    queue = IngestQueue(spark, f"file://{tmp_path}/q")
    schema = spark.createDataFrame([], "name string, age long").schema
    a = queue.submit("Person", "name,age\nA,1\nB,x\n")
    b = queue.submit("Person", "name,age\nonly\n")
    assert {r.status for r in queue.jobs({"Person": schema}).collect()} == {"pending"}
    assert rows(queue.run("Person", schema)) == [("A", 1)]
    c = queue.submit("Person", spark.createDataFrame([("C", "3")], "name string, age string"))
    assert rows(queue.run("Person", schema)) == [("A", 1), ("C", 3)]
    got = {r.id: (r.status, r.loaded, r.errors) for r in queue.jobs({"Person": schema}).collect()}
    assert got == {a: ("completed", 1, 1), b: ("failed", 0, 1), c: ("completed", 1, 0)}
    assert queue.clean(-60) == 3


def test_changelog(people, spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/log")
    log.append([(0, "CREATE (p:Person {name: 'A', age: 1})"), (1, "broken")])
    assert log.append([(0, "CREATE (p:Person {name: 'B'})")]) == 3
    assert ChangeLog(spark, f"file://{tmp_path}/log").head == 3
    assert [r.seq for r in log.read(1, shard_id=0).collect()] == [3]
    assert log.replay(people) == (3, 1)
    assert rows(people.cypher("MATCH (p:Person) RETURN p.name AS n")) == [("A",), ("B",)]
    acks = spark.createDataFrame([(0, "x", 1), (0, "x", 3), (1, "x", 9)], "shard_id int, node string, seq long")
    heads = log.status().select("shard_id", F.col("last_seq").alias("head"))
    assert rows(lag(acks, heads).select("shard_id", "position", "lag")) == [(0, 3, 0), (1, 9, 0)]
    log.truncate(2)
    assert [r.seq for r in log.read().collect()] == [3]


def test_paths_from_both_ends(spark):
    """Pairs that are searched for from both ends have the lengths of a plain breadth-first search; loops too."""
    rng = random.Random(5)
    edges = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(70)})
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    want = {}
    for s in range(0, 40, 4):
        seen, queue = {}, deque((x, 1) for x in out.get(s, ()))
        while queue:
            x, n = queue.popleft()
            if x not in seen and n <= 5:
                seen[x] = n
                queue.extend((y, n + 1) for y in out.get(x, ()))
        want |= {(s, e): seen[e] for e in (s, 1, 7, 39) if e in seen}
    pairs = spark.createDataFrame([(s, e) for s in range(0, 40, 4) for e in sorted({s, 1, 7, 39})], "_start long, _end long")
    df = spark.createDataFrame(edges, "_from long, _to long")
    got = paths.shortest_lengths(pairs.select("_start").distinct(), df, 1, 5, pairs)
    assert {(r._start, r._end): r._len for r in got.collect()} == want


def test_keys_are_checked_on_load(spark, tmp_path):
    e = Engine(spark)
    e.cypher("CREATE NODE TABLE City(name STRING, size INT64, PRIMARY KEY(name))")
    (tmp_path / "a.csv").write_text("name,size\na,1\na,2\n")
    with pytest.raises(QueryError):
        e.cypher(f"COPY City FROM '{tmp_path}/a.csv' (HEADER=true)")
    (tmp_path / "b.csv").write_text("name,size\nb,1\nc,2\n")
    e.cypher(f"COPY City FROM '{tmp_path}/b.csv' (HEADER=true)")
    with pytest.raises(QueryError):
        e.cypher(f"COPY City FROM '{tmp_path}/b.csv' (HEADER=true)")
    assert e.cypher("MATCH (c:City) RETURN count(c) AS n").collect()[0].n == 2


def test_paths_without_bound_end_when_nothing_new_is_reached(spark):
    chain = [(i, i + 1) for i in range(36)] + [(50, 51), (51, 50)]
    df = spark.createDataFrame(chain, "_from long, _to long")
    starts = spark.createDataFrame([(0,), (50,)], "_start long")
    every = rows(paths.shortest_lengths(starts, df, 1, paths.ENDLESS).select("_start", "_end", "_len"))
    assert every == sorted([(0, i, i) for i in range(1, 37)] + [(50, 51, 1), (50, 50, 2)], key=repr)
    assert rows(paths.reachable(starts, df, 34, None)) == sorted([(0, 34), (0, 35), (0, 36), (50, 50), (50, 51)], key=repr)
    pair = spark.createDataFrame([(0, 36), (36, 0)], "_start long, _end long")
    assert rows(paths.shortest_lengths(pair.select("_start"), df, 1, paths.ENDLESS, pair)) == [(0, 36, 36)]
