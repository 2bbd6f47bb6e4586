import datetime as dt

import pytest
from pyspark.sql import functions as F

from lattica.cypher.parser import parse
from lattica.cypher.render import bind_text, literal
from lattica.engine import Engine
from lattica.errors import DatabaseError, ParseError, QueryError
from lattica.sources import csv_io, snapshot
from lattica.streaming.changelog import ChangeLog
from lattica.streaming.ingest import IngestQueue


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def make(spark, **options):
    e = Engine(spark, **options)
    e.cypher("CREATE NODE TABLE P(name STRING, age INT64, PRIMARY KEY(name))")
    e.cypher("CREATE REL TABLE K(FROM P TO P, since INT64)")
    return e


@pytest.fixture
def e(spark):
    out = make(spark)
    out.graph.bind("P", spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", None)], out.graph.node("P").df.schema))
    out.graph.bind("K", spark.createDataFrame([("a", "b", 1), ("a", "b", 1), ("b", "c", 2), ("c", "a", None)], out.graph.rel("K").df.schema))
    return out


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MATCH (p:P) WHERE (p)-[:K]->() RETURN p.name", ["a", "b", "c"]),
        ("MATCH (p:P) WHERE NOT (p)-[:K]->(:P) RETURN p.name", ["d"]),
        ("MATCH (p:P) WHERE exists((p)<-[:K {since: 2}]-()) RETURN p.name", ["c"]),
        ("MATCH (p:P) WHERE EXISTS { MATCH (p)-[:K]->(x:P) WHERE x.age > p.age } RETURN p.name", ["a", "b"]),
        ("MATCH (p:P) WHERE NOT EXISTS { (p)-[:K]->(x:P) WHERE x.age > p.age } OR p.age = 1 RETURN p.name", ["a", "c", "d"]),
        ("MATCH (p:P) WHERE EXISTS { (p)-[:K]->(x:P) WHERE NOT (x)-[:K {since: 2}]->() } RETURN p.name", ["b", "c"]),
        ("MATCH (p:P) WHERE COUNT { (p)-[:K]->(:P) } > 1 RETURN p.name", ["a"]),
        ("MATCH (p:P) WHERE EXISTS { (p)-[:K*2..2]->(q:P {name: 'a'}) } RETURN p.name", ["b"]),
        ("MATCH (p:P) WHERE EXISTS { (z:P {age: 99}) } RETURN p.name", []),
        ("MATCH (p:P) WHERE EXISTS { (z:P {age: 3}) } AND (p.age) - (1) > 1 RETURN p.name", ["c"]),
        ("MATCH (p:P) WHERE (p)-[:K {since: p.age}]->() RETURN p.name", ["a", "b"]),
        ("MATCH (p:P) OPTIONAL MATCH (p)-[:K]->(x) WITH p, x WHERE NOT (x)-[:K]->(:P) RETURN p.name", ["d"]),
    ],
)
def test_patterns_in_where(e, text, want):
    assert [r[0] for r in rows(e.cypher(text))] == want


def test_patterns_in_results(e):
    got = e.cypher("MATCH (p:P) RETURN p.name AS n, COUNT { (p)-[:K]->(:P) } AS c, EXISTS { (p)<-[:K]-() } AS i")
    assert rows(got) == [("a", 2, True), ("b", 1, True), ("c", 1, True), ("d", 0, False)]
    assert rows(e.cypher("MATCH (p:P) WITH p, COUNT { (p)-[:K]->() } AS c RETURN c, count(*) AS n")) == [(0, 1), (1, 2), (2, 1)]
    assert "LeftAnti" in e.cypher("MATCH (p:P) WHERE NOT (p)-[:K]->(:P) RETURN p.name")._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(QueryError):
        e.cypher("MATCH (p:P)-[r:K]->(q) WHERE EXISTS { (q)-[r:K]->() } RETURN p")
    with pytest.raises(ParseError):
        parse("MATCH (p:P) WHERE EXISTS { } RETURN p")


def test_equal_relationships(e):
    count = lambda: rows(e.cypher("MATCH (a:P)-[r:K]->(b) RETURN a.name, r.since"))
    assert rows(e.cypher("MATCH (a:P)-[r:K]-(b) RETURN count(DISTINCT r) AS n, count(r) AS m")) == [(4, 8)]
    assert e.cypher("MATCH (a:P)-[r:K]->(b) RETURN DISTINCT r").count() == 4
    assert e.cypher("MATCH (a:P)-[r:K]->(b) WITH r AS z RETURN z, count(*) AS n").count() == 4
    assert rows(e.cypher("MATCH (a:P)-[r:K]->(b) RETURN size(collect(DISTINCT r)) AS n")) == [(4,)]
    e.cypher("MATCH (a:P)-[r:K]->(b) WHERE r.since = 1 WITH r AS t LIMIT 1 SET t.since = 7")
    assert count() == [("a", 1), ("a", 7), ("b", 2), ("c", None)]
    e.cypher("MATCH (a:P {name: 'a'}), (b:P {name: 'b'}) CREATE (a)-[:K {since: 1}]->(b)")
    e.cypher("MATCH (a:P)-[r:K]->(b) WHERE r.since = 1 WITH r LIMIT 1 DELETE r")
    assert count() == [("a", 1), ("a", 7), ("b", 2), ("c", None)]
    e.cypher("MATCH (a:P)-[r:K]->(b) WHERE r.since IS NULL DELETE r")
    assert count() == [("a", 1), ("a", 7), ("b", 2)]


def test_trails(spark, e):
    """A trail uses no relationship twice, in neither direction; equal ones are two."""
    t = Engine(spark, mode="trail")
    t.databases._graphs["default"] = e.graph
    edges = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a")]

    def trails(at, used, left):
        for i, (x, y) in enumerate(edges):
            if left and i not in used and at in (x, y):
                yield 1
                yield from trails(y if at == x else x, used | {i}, left - 1)

    assert rows(t.cypher("MATCH (p:P {name: 'a'})-[r:K*1..4]-(x) RETURN count(*) AS n")) == [(sum(trails("a", frozenset(), 4)),)]


def test_rendered(spark):
    assert literal([1, "o'\\x\n", None, True, dt.date(2020, 1, 2), {"k": 1.5}]) == "[1, 'o\\'\\\\x\\n', NULL, true, date('2020-01-02'), {`k`: 1.5}]"
    assert bind_text("RETURN '$a' AS x, $a AS y", {"a": "q'"}) == "RETURN '$a' AS x, 'q\\'' AS y"
    with pytest.raises(QueryError):
        bind_text("RETURN $b", {})
    out = Engine(spark).cypher(f"RETURN {literal(float('nan'))} AS n, {literal(dt.date(2020, 1, 2))} AS d, {literal(dt.datetime(2020, 1, 2, 3, 4, 5))} AS t").first()
    assert out.n != out.n and out.d == dt.date(2020, 1, 2) and out.t == dt.datetime(2020, 1, 2, 3, 4, 5)


def test_edges_as_statements(spark, e):
    again = make(spark)
    for table in ("P", "K"):
        ran, failed = csv_io.run_statements(again, csv_io.to_statements(e.graph, table))
        assert (ran, failed) == (4, 0)
    for t in ("node", "rel"):
        assert rows(getattr(again.graph, t)("P" if t == "node" else "K").df) == rows(getattr(e.graph, t)("P" if t == "node" else "K").df)
    assert csv_io.run_statements(again, spark.createDataFrame([("broken",)], "statement string")) == (0, 1)


def test_logged_writes(spark, tmp_path):
    """Replay of the log builds the graph again; readings are not logged, nor what a replay runs."""
    log = ChangeLog(spark, f"file://{tmp_path}/log")
    one = make(spark, log=log)
    one.cypher("CREATE (p:P {name: $n, age: $a})", {"n": "it's", "a": 3})
    one.cypher("MATCH (p:P) RETURN p.name")
    one.admin("CREATE DATABASE other")
    one.cypher("CREATE NODE TABLE Q(k INT64, PRIMARY KEY(k))", database="other")
    one.cypher("CREATE (q:Q {k: 5})", database="other")
    assert log.head == 6
    two = Engine(spark, log=log)
    assert log.replay(two) == (6, 0) and log.head == 6
    assert rows(two.cypher("MATCH (p:P) RETURN p.name, p.age")) == [("it's", 3)]
    assert rows(two.cypher("MATCH (q:Q) RETURN q.k", database="other")) == [(5,)]
    log.truncate(6)
    assert ChangeLog(spark, f"file://{tmp_path}/log").head == 6 and log.read().count() == 0
    # a version that was not written whole does not count
    (tmp_path / "log" / f"log-{9:020d}").mkdir()
    assert log.append([(0, "x")]) == 7 and [r.seq for r in ChangeLog(spark, f"file://{tmp_path}/log").read().collect()] == [7]


def test_ingest_into_graph(spark, e, tmp_path):
    queue = IngestQueue(spark, f"file://{tmp_path}/q")
    queue.submit("P", "name,age\nz,9\na,11\n,5\nb,\n")
    queue.submit("K", spark.range(40).select(F.lit("z").alias("from"), F.concat(F.lit("n"), F.col("id")).alias("to"), F.col("id").alias("since")).repartition(5), kind="edges")
    assert queue.deliver(e.graph, "P") == 4 and queue.deliver(e.graph, "K") == 40
    assert queue.deliver(e.graph, "P") == 0 and queue.deliver(e.graph, "K") == 0
    assert rows(e.cypher("MATCH (p:P) WHERE size(p.name) = 1 RETURN p.name, p.age")) == [("a", 11), ("b", 2), ("c", 3), ("d", None), ("z", 9)]
    assert rows(e.cypher("MATCH (:P {name: 'z'})-[r:K]->(x) RETURN count(x) AS n, sum(r.since) AS s")) == [(40, 780)]
    kept = snapshot.save(e.graph, f"file://{tmp_path}/s")
    back = Engine(spark)
    snapshot.restore(back.graph, kept)
    queue.submit("K", "from,to,since\nz,a,1\n", kind="edges")
    assert queue.deliver(back.graph, "K") == 1 and back.graph.rel("K").df.count() == 45


def test_scheduler(spark, e, tmp_path):
    s = snapshot.Scheduler(lambda: e.graph, f"file://{tmp_path}/s", 0.2, 2, log_position=lambda: 12)
    s.start()
    while len(s.saved) < 3 and not s.errors:
        pass
    s.stop()
    assert not s.errors and len(snapshot.snapshots(spark, f"file://{tmp_path}/s")) == 2
    assert snapshot.manifest(spark, s.saved[-1])["wal_sequence"] == 12
    bad = snapshot.Scheduler(lambda: 1 / 0, f"file://{tmp_path}/s", 1, 1)
    assert bad.run_once() is None and "ZeroDivisionError" in bad.errors[0]
    with pytest.raises(DatabaseError):
        snapshot.Scheduler(e.graph, "x", 0, 1)
