import pytest
from pyspark.sql import Row

from lattica.cypher.parser import parse
from lattica.engine import Engine
from lattica.errors import DatabaseError, ParseError, QueryError

PEOPLE = [("Ann", 30, "X"), ("Bob", 25, "X"), ("Cid", None, "Y"), ("Dee", 41, "Y"), ("Eve", 25, "Z"), ("Fay", 60, None)]
EDGES = [("Ann", "Bob", 2020), ("Bob", "Cid", 2021), ("Cid", "Ann", 2022), ("Ann", "Dee", 2020), ("Ann", "Dee", 2021), ("Dee", "Eve", 2019), ("Eve", "Eve", 2018), ("Dee", "Bob", 2023)]


@pytest.fixture
def e(spark):
    out = Engine(spark)
    out.cypher("CREATE NODE TABLE Person(name STRING, age INT64, city STRING, PRIMARY KEY(name))")
    out.cypher("CREATE REL TABLE KNOWS(FROM Person TO Person, since INT64)")
    out.graph.bind("Person", spark.createDataFrame(PEOPLE, out.graph.node("Person").df.schema))
    out.graph.bind("KNOWS", spark.createDataFrame(EDGES, out.graph.rel("KNOWS").df.schema))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_reads(e):
    assert rows(e.cypher("MATCH (p:Person {name: 'Ann'}) RETURN p.name, p.age")) == [("Ann", 30)]
    assert e.cypher("MATCH (p:Person {name: 'Ann'}) RETURN p.name, p.age").columns == ["p.name", "p.age"]
    assert rows(e.cypher("MATCH (p:Person) WHERE p.age = 25 OR p.city = 'Y' RETURN p.name AS n")) == [("Bob",), ("Cid",), ("Dee",), ("Eve",)]
    assert rows(e.cypher("MATCH (p:Person) WHERE p.age IS NULL RETURN p.name AS n")) == [("Cid",)]
    assert [r[0] for r in e.cypher("MATCH (p:Person) RETURN p.name AS n ORDER BY p.age, n").collect()] == ["Cid", "Bob", "Eve", "Ann", "Dee", "Fay"]
    assert [r[0] for r in e.cypher("MATCH (p:Person) RETURN p.name AS n ORDER BY n DESC SKIP 1 LIMIT 2").collect()] == ["Eve", "Dee"]
    assert rows(e.cypher("MATCH (p:Person) RETURN p.city AS c, count(*) AS n, avg(p.age) AS a")) == sorted([("X", 2, 27.5), ("Y", 2, 41.0), ("Z", 1, 25.0), (None, 1, 60.0)], key=repr)
    assert rows(e.cypher("MATCH (p:Person) WHERE p.name = 'No' RETURN count(p) AS n, avg(p.age) AS a")) == [(0, None)]
    assert rows(e.cypher("MATCH (p:Person) WHERE p.name IN $names RETURN p.name AS n", {"names": ["Ann", "O'Brien"]})) == [("Ann",)]
    assert e.cypher("MATCH (p:Person {name: 'Ann'}) RETURN p").collect()[0][0] == Row(_id="Ann", _label="Person", name="Ann", age=30, city="X")


def test_expand(e):
    assert rows(e.cypher("MATCH (a:Person {name: 'Ann'})-[:KNOWS]->(b) RETURN b.name AS n")) == [("Bob",), ("Dee",), ("Dee",)]
    assert rows(e.cypher("MATCH (a:Person {name: 'Bob'})<-[r:KNOWS]-(b) RETURN b.name AS n, r.since AS s")) == [("Ann", 2020), ("Dee", 2023)]
    assert rows(e.cypher("MATCH (a:Person {name: 'Eve'})-[:KNOWS]-(b) RETURN b.name AS n")) == [("Dee",), ("Eve",)]
    assert rows(e.cypher("MATCH (a)-[:KNOWS]->(b)-[:KNOWS]->(a) RETURN a.name AS n")) == [("Eve",)]
    assert rows(e.cypher("MATCH (a:Person {name: 'Ann'})-->(m)<--(b:Person {name: 'Dee'}) RETURN m.name AS n")) == [("Bob",)]
    assert rows(e.cypher("MATCH (a:Person)-[r:KNOWS {since: 2020}]->(b) RETURN a.name AS a, b.name AS b")) == [("Ann", "Bob"), ("Ann", "Dee")]
    assert rows(e.cypher("MATCH (a:Person) OPTIONAL MATCH (a)-[r:KNOWS]->(b) RETURN a.name AS a, count(r) AS n")) == [("Ann", 3), ("Bob", 1), ("Cid", 1), ("Dee", 2), ("Eve", 1), ("Fay", 0)]
    assert rows(e.cypher("MATCH (a:Person {name: 'Fay'}), (b:Person {name: 'Ann'}) RETURN a.age + b.age AS s")) == [(90,)]
    assert rows(e.cypher("MATCH (a:Person)-[:KNOWS]->(b) WITH a, count(DISTINCT b) AS n WHERE n > 1 RETURN a.name AS a, n")) == [("Ann", 2), ("Dee", 2)]
    assert rows(e.cypher("MATCH (x) RETURN count(x) AS n")) == [(6,)]


def test_paths(e):
    assert rows(e.cypher("MATCH (a:Person {name: 'Dee'})-[r:KNOWS*1..2]->(b) RETURN b.name AS n, length(r) AS k")) == [("Bob", 1), ("Cid", 2), ("Eve", 1), ("Eve", 2)]
    assert rows(e.cypher("MATCH (a:Person {name: 'Dee'})-[:KNOWS*2..3]->(b) RETURN DISTINCT b.name AS n")) == [("Ann",), ("Cid",), ("Eve",)]
    assert rows(e.cypher("MATCH (a:Person {name: 'Bob'})-[r:KNOWS* SHORTEST 1..6]->(b:Person {name: 'Eve'}) RETURN length(r) AS k")) == [(4,)]
    assert rows(e.cypher("MATCH (a:Person {name: 'Bob'})-[r:KNOWS* SHORTEST 1..3]->(b:Person {name: 'Eve'}) RETURN length(r) AS k")) == []
    assert rows(e.cypher("MATCH (a:Person {name: 'Fay'})-[r:KNOWS* SHORTEST 1..6]->(b:Person) RETURN length(r) AS k")) == []
    assert rows(e.cypher("MATCH (a:Person {name: 'Ann'})-[r:KNOWS* ALL SHORTEST 1..6]->(b:Person {name: 'Eve'}) RETURN length(r) AS k")) == [(2,), (2,)]
    trail = Engine(e.spark, mode="trail")
    trail.databases._graphs["default"] = e.graph
    assert rows(trail.cypher("MATCH (a:Person {name: 'Eve'})-[r:KNOWS*1..4]->(b) RETURN length(r) AS k")) == [(1,)]
    assert rows(e.cypher("MATCH (a:Person {name: 'Eve'})-[r:KNOWS*1..4]->(b) RETURN length(r) AS k")) == [(1,), (2,), (3,), (4,)]


def test_other_clauses(e):
    assert rows(e.cypher("UNWIND [1, 2, 3] AS x RETURN x * 2 AS y")) == [(2,), (4,), (6,)]
    assert rows(e.cypher("UNWIND $rows AS r RETURN r.a AS a", {"rows": [{"a": 1}, {"a": 2}]})) == [(1,), (2,)]
    assert rows(e.cypher("RETURN 1")) == [(1,)]
    assert rows(e.cypher("CALL show_tables() YIELD name RETURN name")) == [("KNOWS",), ("Person",)]
    assert rows(e.cypher("MATCH (p:Person) RETURN DISTINCT p.age AS a UNION ALL RETURN 1 AS a")) == sorted([(30,), (25,), (None,), (41,), (60,), (1,)], key=repr)
    assert rows(e.cypher("RETURN 'it\\'s' AS a, \"O''Brien\" AS b, toUpper('x') + 'y' AS c, 7 % 4 AS d")) == [("it's", "O''Brien", "Xy", 3)]


def test_writes(e):
    e.cypher("CREATE (p:Person {name: 'Gus', age: 5})")
    assert rows(e.cypher("MATCH (p:Person {name: 'Gus'}) RETURN p.age AS a, p.city AS c")) == [(5, None)]
    with pytest.raises(QueryError):
        e.cypher("CREATE (p:Person {name: 'Gus'})")
    e.cypher("MATCH (a:Person {name: 'Gus'}), (b:Person {name: 'Ann'}) CREATE (a)-[:KNOWS {since: 1}]->(b)")
    assert rows(e.cypher("MATCH (a:Person {name: 'Gus'})-[r:KNOWS]->(b) RETURN b.name AS n, r.since AS s")) == [("Ann", 1)]
    e.cypher("MERGE (p:Person {name: 'Gus'}) ON CREATE SET p.age = 1 ON MATCH SET p.age = p.age + 1")
    e.cypher("MERGE (p:Person {name: 'Hal'}) ON CREATE SET p.age = 1 ON MATCH SET p.age = 2")
    e.cypher("MERGE (p:Person {name: 'Hal'}) ON CREATE SET p.age = 1 ON MATCH SET p.age = 2")
    assert rows(e.cypher("MATCH (p:Person) WHERE p.name IN ['Gus', 'Hal'] RETURN p.name AS n, p.age AS a")) == [("Gus", 6), ("Hal", 2)]
    e.cypher("MATCH (p:Person) WHERE p.city = 'X' SET p.city = 'W'")
    e.cypher("MATCH (p:Person {name: 'Ann'}) REMOVE p.age")
    assert rows(e.cypher("MATCH (p:Person {name: 'Ann'}) RETURN p.age AS a, p.city AS c")) == [(None, "W")]
    with pytest.raises(QueryError):
        e.cypher("MATCH (p:Person {name: 'Gus'}) DELETE p")
    e.cypher("MATCH (p:Person {name: 'Gus'}) DETACH DELETE p")
    e.cypher("MATCH (p:Person {name: 'Hal'}) DELETE p")
    assert rows(e.cypher("MATCH (p:Person) RETURN count(p) AS n")) == [(6,)]
    e.cypher("MATCH (a:Person)-[r:KNOWS]->(b) WHERE r.since < 2020 DELETE r")
    assert rows(e.cypher("MATCH (a:Person)-[r:KNOWS]->(b) RETURN count(r) AS n")) == [(6,)]
    e.cypher("MATCH (a:Person {name: 'Ann'}), (b:Person {name: 'Fay'}) MERGE (a)-[:KNOWS {since: 7}]->(b)")
    e.cypher("MATCH (a:Person {name: 'Ann'}), (b:Person {name: 'Fay'}) MERGE (a)-[:KNOWS {since: 7}]->(b)")
    assert rows(e.cypher("MATCH (a:Person)-[r:KNOWS]->(b:Person {name: 'Fay'}) RETURN a.name AS n")) == [("Ann",)]


def test_ddl_and_admin(spark):
    e = Engine(spark)
    e.cypher("CREATE NODE TABLE Co( id STRING PRIMARY KEY , revenue DOUBLE )")
    e.cypher("CREATE NODE TABLE IF NOT EXISTS co(id STRING, PRIMARY KEY(id))")
    e.cypher("ALTER TABLE Co ADD size INT64 DEFAULT 3")
    e.cypher("CREATE (c:Co {id: 'a', revenue: 2.5, size: 4})")
    e.cypher("ALTER TABLE Co RENAME size TO staff")
    assert rows(e.cypher("MATCH (c:co) RETURN c.id AS i, c.staff AS s")) == [("a", 4)]
    e.cypher("ALTER TABLE Co DROP staff")
    e.cypher("DROP TABLE Co")
    with pytest.raises(QueryError):
        e.cypher("MATCH (c:Co) RETURN c.id")
    with pytest.raises(ParseError):
        e.cypher("CREATE NODE TABLE Co(id STRING)")
    e.admin("CREATE DATABASE Sales-1 SHARDS 5")
    assert rows(e.admin("SHOW DATABASES").select("name", "state", "shard_count")) == [("default", "ONLINE", 3), ("sales-1", "ONLINE", 5)]
    assert e.databases.get("sales-1").shard_ids == [3, 4, 5, 6, 7]
    e.admin("STOP DATABASE sales-1")
    with pytest.raises(DatabaseError):
        e.cypher("RETURN 1", database="sales-1")
    with pytest.raises(DatabaseError):
        e.admin("STOP DATABASE sales-1")
    e.admin("START DATABASE sales-1")
    assert rows(e.database("sales-1").cypher("RETURN 1")) == [(1,)]
    e.admin("DROP DATABASE sales-1")
    with pytest.raises(DatabaseError):
        e.admin("CREATE DATABASE sales-1")
    e.databases.remove_tombstone("sales-1")
    e.admin("CREATE DATABASE sales-1")
    assert e.databases.get("sales-1").shard_ids == [8, 9, 10]
    text = e.databases.dump()
    e.databases.load(text)
    assert e.databases.dump() == text


@pytest.mark.parametrize("text", ["", "MATCH", "MATCH (a RETURN a", "RETURN", "FOO", "MATCH (a) RETURN a LIMIT", "MATCH (a)-[>(b) RETURN a", "WITH 1 RETURN 1", "CREATE REL TABLE R(A TO B)"])
def test_parse_errors(text):
    with pytest.raises(ParseError):
        parse(text)
