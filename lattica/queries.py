"""The registered queries of the graph engine, and the SQL that tells their results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .operators import analytics, bloom, paths
from .operators.dedup import dedup_stubs
from .sources import csv_io
from .sources.tables import social_graph, trade_graph
from .streaming import changelog
from .streaming.ingest import IngestQueue

SHARDS = 4
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

PERSON = "person AS (SELECT c_name AS name, CAST(18 + c_custkey % 62 AS BIGINT) AS age, c_mktsegment AS city, c_custkey AS id FROM customer)"
KNOWS = "knows AS (SELECT o_custkey AS src, o_orderkey % (SELECT count(*) FROM customer) AS dst, CAST(2015 + o_orderkey % 11 AS BIGINT) AS since FROM orders WHERE o_custkey <> o_orderkey % (SELECT count(*) FROM customer))"
NAMED = "named AS (SELECT a.name AS src, b.name AS dst, since FROM knows k JOIN person a ON a.id = k.src JOIN person b ON b.id = k.dst)"
#: FNV-1a of a key's bytes, 32 bits.
FNV = "list_reduce(list_concat([CAST(2166136261 AS UBIGINT)], list_transform(range(0, CAST(length({k}) AS BIGINT)), lambda i: CAST(ascii({k}[i + 1]) AS UBIGINT))), lambda h, b: (xor(h, b) * CAST(16777619 AS UBIGINT)) & CAST(4294967295 AS UBIGINT))"


def shard_sql(key: str, shards: int = SHARDS) -> str:
    return f"CAST({FNV.format(k=key)} % {shards} AS INTEGER)"


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def engine(spark: SparkSession, sf_dir: str, graph=social_graph, **options) -> Engine:
    out = Engine(spark, **options)
    out.databases._graphs["default"] = graph(spark, sf_dir)
    return out


def cypher(name: str, text: str, sql: str, params: dict | None = None, graph=social_graph) -> None:
    """A reading query over a graph; columns are named the same in both texts."""
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir, graph).cypher(text, params)
    ORACLE_SQL[name] = sql


P, PK = f"WITH {PERSON}", f"WITH {PERSON}, {KNOWS}, {NAMED}"
A7 = "Customer#000000007"

cypher("q01_point_lookup", f"MATCH (p:Person {{name: '{A7}'}}) RETURN p.name AS name, p.age AS age, p.city AS city", f"{P} SELECT name, age, city FROM person WHERE name = '{A7}'")
cypher("q02_range_filter", "MATCH (p:Person) WHERE p.city = 'BUILDING' AND p.age > 40 RETURN p.name AS name, p.age AS age ORDER BY p.name LIMIT 20", f"{P} SELECT name, age FROM person WHERE city = 'BUILDING' AND age > 40 ORDER BY name LIMIT 20")
cypher("q03_count_all", "MATCH (p:Person) RETURN count(p) AS n", f"{P} SELECT count(*) AS n FROM person")
cypher("q04_count_filtered", "MATCH (p:Person) WHERE p.city = $city RETURN count(p) AS n", f"{P} SELECT count(*) AS n FROM person WHERE city = 'BUILDING'", {"city": "BUILDING"})
cypher("q05_avg_min_max", "MATCH (p:Person) WHERE p.city = 'BUILDING' RETURN avg(p.age) AS a, min(p.age) AS lo, max(p.age) AS hi, sum(p.age) AS s", f"{P} SELECT avg(age) AS a, min(age) AS lo, max(age) AS hi, CAST(sum(age) AS BIGINT) AS s FROM person WHERE city = 'BUILDING'")
cypher("q06_group_by_city", "MATCH (p:Person) RETURN p.city AS city, count(p) AS n, round(avg(p.age), 6) AS a ORDER BY count(p) DESC, city", f"{P} SELECT city, count(*) AS n, round(avg(age), 6) AS a FROM person GROUP BY city")
cypher("q07_distinct", "MATCH (p:Person) RETURN DISTINCT p.city AS city", f"{P} SELECT DISTINCT city FROM person")
cypher("q08_order_skip_limit", "MATCH (p:Person) RETURN p.name AS name, p.age AS age ORDER BY p.age DESC, p.name SKIP 5 LIMIT 10", f"{P} SELECT name, age FROM person ORDER BY age DESC, name LIMIT 10 OFFSET 5")
cypher("q09_or_predicate", f"MATCH (p:Person) WHERE p.name = '{A7}' OR p.name = 'Customer#000000009' OR (p.age >= 79 AND p.city <> 'BUILDING') RETURN p.name AS name", f"{P} SELECT name FROM person WHERE name IN ('{A7}', 'Customer#000000009') OR (age >= 79 AND city <> 'BUILDING')")
cypher("q10_count_distinct", "MATCH (p:Person) RETURN count(DISTINCT p.age) AS ages, count(DISTINCT p) AS people, min(p.name) AS first, max(p.name) AS last", f"{P} SELECT count(DISTINCT age) AS ages, count(DISTINCT name) AS people, min(name) AS first, max(name) AS last FROM person")
cypher("q11_one_hop", f"MATCH (a:Person {{name: '{A7}'}})-[:KNOWS]->(b) RETURN b.name AS name, b.city AS city", f"{PK} SELECT p.name, p.city FROM named n JOIN person p ON p.name = n.dst WHERE n.src = '{A7}'")
cypher("q12_one_hop_in", f"MATCH (a:Person {{name: '{A7}'}})<-[:KNOWS]-(b) RETURN b.name AS name", f"{PK} SELECT src AS name FROM named WHERE dst = '{A7}'")
cypher("q13_undirected", f"MATCH (a:Person {{name: '{A7}'}})-[:KNOWS]-(b) RETURN b.name AS name", f"{PK} SELECT dst AS name FROM named WHERE src = '{A7}' UNION ALL SELECT src FROM named WHERE dst = '{A7}' AND src <> dst")
cypher("q14_rel_property", "MATCH (a:Person)-[r:KNOWS {since: 2020}]->(b:Person) WHERE a.city = 'BUILDING' RETURN a.name AS a, b.name AS b, r.since AS since", f"{PK} SELECT src AS a, dst AS b, since FROM named JOIN person p ON p.name = src WHERE since = 2020 AND p.city = 'BUILDING'")
cypher("q15_two_hop", f"MATCH (a:Person {{name: '{A7}'}})-[:KNOWS]->(b)-[:KNOWS]->(c) RETURN b.name AS b, c.name AS c ORDER BY b, c LIMIT 20", f"{PK} SELECT x.dst AS b, y.dst AS c FROM named x JOIN named y ON x.dst = y.src WHERE x.src = '{A7}' ORDER BY b, c LIMIT 20")
cypher("q16_mutual", f"MATCH (a:Person {{name: '{A7}'}})-[:KNOWS]->(m)<-[:KNOWS]-(b:Person) WHERE b.name <> a.name RETURN DISTINCT m.name AS m, b.name AS b", f"{PK} SELECT DISTINCT x.dst AS m, y.src AS b FROM named x JOIN named y ON x.dst = y.dst WHERE x.src = '{A7}' AND y.src <> '{A7}'")
cypher("q17_fof_count", f"MATCH (a:Person {{name: '{A7}'}})-[:KNOWS]->(b)-[:KNOWS]->(c) WHERE a.name <> c.name RETURN count(DISTINCT c) AS n", f"{PK} SELECT count(DISTINCT y.dst) AS n FROM named x JOIN named y ON x.dst = y.src WHERE x.src = '{A7}' AND y.dst <> '{A7}'")
cypher("q18_optional", "MATCH (a:Person) WHERE a.age = 30 OPTIONAL MATCH (a)-[r:KNOWS {since: 2021}]->(b:Person) RETURN a.name AS a, b.name AS b, count(r) AS n", f"{PK} SELECT p.name AS a, n.dst AS b, count(n.dst) AS n FROM person p LEFT JOIN named n ON n.src = p.name AND n.since = 2021 WHERE p.age = 30 GROUP BY 1, 2")
_WALK = " UNION ALL ".join(f"SELECT {k} AS hops, k{k}.dst AS dst FROM named k1 {' '.join(f'JOIN named k{j} ON k{j}.src = k{j - 1}.dst' for j in range(2, k + 1))} WHERE k1.src = '{A7}'" for k in (1, 2, 3))
cypher("q19_var_length_distinct", f"MATCH (a:Person {{name: '{A7}'}})-[:KNOWS*1..3]->(b:Person) RETURN DISTINCT b.name AS name", f"{PK}, w AS ({_WALK}) SELECT DISTINCT dst AS name FROM w")
cypher("q20_var_length_count", f"MATCH (a:Person {{name: '{A7}'}})-[r:KNOWS*1..3]->(b:Person) RETURN length(r) AS hops, count(*) AS n", f"{PK}, w AS ({_WALK}) SELECT hops, count(*) AS n FROM w GROUP BY hops")
_BFS = "RECURSIVE bfs(name, hops) AS (SELECT '" + A7 + "', 0 UNION SELECT n.dst, b.hops + 1 FROM bfs b JOIN named n ON n.src = b.name WHERE b.hops < 6)"
cypher("q21_shortest_lengths", f"MATCH (a:Person {{name: '{A7}'}})-[r:KNOWS* SHORTEST 1..6]->(b:Person) RETURN b.name AS name, length(r) AS hops", f"WITH {_BFS.replace('RECURSIVE ', 'RECURSIVE ' + PERSON + ', ' + KNOWS + ', ' + NAMED + ', ', 1)} SELECT name, min(hops) AS hops FROM bfs WHERE hops > 0 GROUP BY name")
cypher("q21b_shortest_pair", f"MATCH (a:Person {{name: '{A7}'}})-[r:KNOWS* SHORTEST 1..6]->(b:Person {{name: 'Customer#000000042'}}) RETURN length(r) AS hops", f"WITH {_BFS.replace('RECURSIVE ', 'RECURSIVE ' + PERSON + ', ' + KNOWS + ', ' + NAMED + ', ', 1)} SELECT min(hops) AS hops FROM bfs WHERE hops > 0 AND name = 'Customer#000000042' HAVING count(*) > 0")
cypher("q22_with_pipeline", "MATCH (a:Person)-[:KNOWS]->(b:Person) WITH a, count(b) AS friends WHERE friends > 12 MATCH (a)-[:KNOWS]->(c:Person) RETURN a.name AS name, friends, count(DISTINCT c.city) AS cities ORDER BY friends DESC, name LIMIT 25", f"{PK}, f AS (SELECT src, count(*) AS friends FROM named GROUP BY src HAVING count(*) > 12) SELECT f.src AS name, friends, count(DISTINCT p.city) AS cities FROM f JOIN named n ON n.src = f.src JOIN person p ON p.name = n.dst GROUP BY 1, 2 ORDER BY friends DESC, name LIMIT 25")
cypher("q23_unwind", "UNWIND [20, 30, 40] AS x MATCH (p:Person) WHERE p.age = x RETURN x, count(p) AS n", f"{P} SELECT age AS x, count(*) AS n FROM person WHERE age IN (20, 30, 40) GROUP BY age")
cypher("q24_table_info", "CALL table_info('Person') RETURN *", "SELECT * FROM (VALUES (0, 'name', 'STRING', 'NULL', true), (1, 'age', 'INT64', 'NULL', false), (2, 'city', 'STRING', 'NULL', false), (3, 'id', 'INT64', 'NULL', false)) t(\"property id\", name, type, \"default expression\", \"primary key\")")
cypher("q24b_show_tables", "CALL show_tables() YIELD name, type RETURN name, type", "SELECT * FROM (VALUES ('Person', 'NODE'), ('KNOWS', 'REL')) t(name, type)")
cypher("q24c_literal", "RETURN 1 AS one, 'a' + 'b' AS ab, [1, 2, 3] AS xs, CASE WHEN 2 > 1 THEN 'y' ELSE 'n' END AS c", "SELECT CAST(1 AS BIGINT) AS one, 'ab' AS ab, [1, 2, 3]::BIGINT[] AS xs, 'y' AS c")
cypher("q24d_union", "MATCH (p:Person) WHERE p.age = 20 RETURN p.city AS city UNION MATCH (p:Person) WHERE p.age = 21 RETURN p.city AS city", f"{P} SELECT city FROM person WHERE age = 20 UNION SELECT city FROM person WHERE age = 21")
cypher("q24e_rel_value", f"MATCH (a:Person {{name: '{A7}'}})-[r:KNOWS]->(b) WITH r, b.name AS n RETURN r.since AS since, n", f"{PK} SELECT since, dst AS n FROM named WHERE src = '{A7}'")
cypher("q24f_cross_product", f"MATCH (a:Person {{name: '{A7}'}}), (b:Person {{name: 'Customer#000000009'}}) RETURN a.age + b.age AS s", f"{P} SELECT a.age + b.age AS s FROM person a, person b WHERE a.name = '{A7}' AND b.name = 'Customer#000000009'")
cypher("q24g_star", f"MATCH (p:Person {{name: '{A7}'}}) RETURN p.*", f'{P} SELECT name AS "p.name", age AS "p.age", city AS "p.city", id AS "p.id" FROM person WHERE name = \'{A7}\'')

cypher("q42_nations_by_region", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS region, count(DISTINCT n) AS nations, count(c) AS customers", "SELECT r_name AS region, count(DISTINCT n_nationkey) AS nations, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1", graph=trade_graph)
cypher("q43_multi_type", "MATCH (x)-[:LIVES_IN|BASED_IN]->(n:Nation) RETURN n.n_name AS nation, count(x) AS n", "SELECT n_name AS nation, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey GROUP BY 1", graph=trade_graph)
cypher("q44_untyped", "MATCH (s:Supplier {s_suppkey: 3})-[]->(x) RETURN label(x) AS label, count(*) AS n", "SELECT 'Nation' AS label, count(*) AS n FROM supplier WHERE s_suppkey = 3 UNION ALL SELECT 'Part', count(*) FROM lineitem WHERE l_suppkey = 3", graph=trade_graph)
cypher("q45_unlabelled", "MATCH (x) RETURN label(x) AS label, count(*) AS n", " UNION ALL ".join(f"SELECT '{n}' AS label, count(*) AS n FROM {t}" for n, t in (("Customer", "customer"), ("Supplier", "supplier"), ("Part", "part"), ("Orders", "orders"), ("Nation", "nation"), ("Region", "region"))), graph=trade_graph)
cypher("q46_returns", "MATCH (c:Customer)-[p:PLACED]->(o:Orders)-[l:CONTAINS]->(t:Part) WHERE c.c_mktsegment = 'BUILDING' AND l.l_returnflag = 'R' RETURN t.p_brand AS brand, count(DISTINCT o) AS orders, sum(l.l_quantity) AS quantity", "SELECT p_brand AS brand, count(DISTINCT o_orderkey) AS orders, sum(l_quantity) AS quantity FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_mktsegment = 'BUILDING' AND l_returnflag = 'R' GROUP BY 1", graph=trade_graph)


cypher("q48_avg_distinct", "MATCH (p:Person) WHERE p.city = 'BUILDING' RETURN avg(DISTINCT p.age) AS a", f"{P} SELECT avg(DISTINCT age) AS a FROM person WHERE city = 'BUILDING'")
cypher("q49_whole_division", "MATCH (p:Person) WHERE p.age > 75 RETURN p.name AS name, p.age / 7 AS q, -7 / 2 AS m, p.age / 2.0 AS h", f"{P} SELECT name, CAST(age // 7 AS BIGINT) AS q, CAST(-3 AS BIGINT) AS m, age / 2.0 AS h FROM person WHERE age > 75")
cypher("q50_size_of_text", "MATCH (p:Person) WHERE size(p.city) > 8 RETURN p.city AS city, max(size(p.name)) AS n", f"{P} SELECT city, CAST(max(length(name)) AS INTEGER) AS n FROM person WHERE length(city) > 8 GROUP BY city")
cypher("q51_nodes_of_hops", f"MATCH (a:Person {{name: '{A7}'}})-[r:KNOWS*2..2]->(b:Person) WITH nodes(r) AS ns, b.name AS name RETURN DISTINCT ns[1] AS mid, size(ns) AS n, name", f"{PK} SELECT DISTINCT x.dst AS mid, CAST(3 AS INTEGER) AS n, y.dst AS name FROM named x JOIN named y ON x.dst = y.src WHERE x.src = '{A7}'")
cypher("q52_exists_pattern", "MATCH (p:Person) WHERE (p)-[:KNOWS {since: 2020}]->(:Person {city: 'BUILDING'}) RETURN p.name AS name", f"{PK} SELECT name FROM person p WHERE EXISTS (SELECT 1 FROM named n JOIN person q ON q.name = n.dst WHERE n.src = p.name AND since = 2020 AND q.city = 'BUILDING')")
cypher("q53_not_exists", "MATCH (p:Person) WHERE NOT EXISTS { MATCH (p)-[r:KNOWS]->(q:Person) WHERE q.age > p.age } AND p.age < 60 RETURN p.name AS name, p.age AS age", f"{PK} SELECT name, age FROM person p WHERE age < 60 AND NOT EXISTS (SELECT 1 FROM named n JOIN person q ON q.name = n.dst WHERE n.src = p.name AND q.age > p.age)")
cypher("q54_count_subquery", "MATCH (p:Person) RETURN p.city AS city, COUNT { (p)-[:KNOWS]->(:Person) } AS friends, count(*) AS n", f"{PK}, f AS (SELECT p.city, p.name, count(n.dst) AS friends FROM person p LEFT JOIN named n ON n.src = p.name GROUP BY 1, 2) SELECT city, friends, count(*) AS n FROM f GROUP BY 1, 2")
cypher("q55_parallel_rels", "MATCH (a:Person)-[r:KNOWS]-(b:Person) RETURN count(DISTINCT r) AS rels, count(r) AS seen", f"{PK} SELECT count(*) AS rels, count(*) + count(*) FILTER (src <> dst) AS seen FROM named")
cypher("q56_all_shortest", f"MATCH (a:Person {{name: '{A7}'}})-[r:KNOWS* ALL SHORTEST 1..3]->(b:Person) RETURN b.name AS name, length(r) AS hops, count(*) AS paths", f"{PK}, w AS ({_WALK}), m AS (SELECT dst, min(hops) AS hops FROM w GROUP BY 1) SELECT w.dst AS name, m.hops AS hops, count(*) AS paths FROM w JOIN m ON m.dst = w.dst AND m.hops = w.hops GROUP BY 1, 2")
cypher("q57_spread", "MATCH (p:Person) RETURN p.city AS city, round(stdev(p.age), 6) AS s, percentileCont(p.age, 0.25) AS q, size(collect(p.age)) AS n, size(collect(DISTINCT p.age)) AS d", f"{P} SELECT city, round(stddev_samp(age), 6) AS s, quantile_cont(age, 0.25) AS q, CAST(count(age) AS INTEGER) AS n, CAST(count(DISTINCT age) AS INTEGER) AS d FROM person GROUP BY 1")
cypher("q58_null_order", "MATCH (p:Person) WITH p.name AS name, CASE WHEN p.age > 40 THEN p.age ELSE NULL END AS a RETURN name, a ORDER BY a, name SKIP 5 LIMIT 40", f"{P} SELECT name, CASE WHEN age > 40 THEN age END AS a FROM person ORDER BY a NULLS FIRST, name LIMIT 40 OFFSET 5")


# ---------------------------------------------------------------- analytics


def people(spark, sf_dir):
    g = social_graph(spark, sf_dir)
    nodes = g.node("Person").df.select(F.col("name").alias("key"))
    return nodes, g.rel("KNOWS").df.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "since")


_S = f"{PK}, sharded AS (SELECT src, dst, {shard_sql('src')} AS a, {shard_sql('dst')} AS b FROM named)"


@register("q25_shard_balance", f"{P}, c AS (SELECT {shard_sql('name')} AS shard, count(*) AS n FROM person GROUP BY 1) SELECT round(min(n) / max(n), 9) AS balance FROM c")
def q25(spark, sf_dir):
    return analytics.shard_balance(people(spark, sf_dir)[0], SHARDS).select(F.round("balance", 9).alias("balance"))


@register("q26_locality", f"{_S} SELECT round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 9) AS locality FROM sharded")
def q26(spark, sf_dir):
    return analytics.locality(people(spark, sf_dir)[1], SHARDS).select(F.round("locality", 9).alias("locality"))


@register("q27_cut_edges", f"{_S} SELECT a AS src_shard, b AS dst_shard, count(*) AS n FROM sharded WHERE a <> b GROUP BY 1, 2")
def q27(spark, sf_dir):
    return analytics.cut_edges(people(spark, sf_dir)[1], SHARDS).groupBy("src_shard", "dst_shard").agg(F.count("*").alias("n"))


@register("q28_border_counts", f"{_S} SELECT a AS shard, count(DISTINCT dst) AS border_nodes FROM sharded WHERE a <> b GROUP BY 1")
def q28(spark, sf_dir):
    return analytics.border_counts(people(spark, sf_dir)[1], SHARDS)


def _lpa_sql(rounds: int) -> str:
    parts = [f"{PK}", "pairs AS (SELECT src AS a, dst AS b FROM named UNION ALL SELECT dst, src FROM named)", f"l0 AS (SELECT name AS key, {shard_sql('name')} AS label FROM person)"]
    for k in range(rounds):
        parts.append(f"v{k} AS (SELECT a, label, count(*) AS n FROM pairs JOIN l{k} ON l{k}.key = b GROUP BY 1, 2)")
        parts.append(f"w{k} AS (SELECT a, label, row_number() OVER (PARTITION BY a ORDER BY n DESC, label) AS r FROM v{k})")
        parts.append(f"l{k + 1} AS (SELECT key, CAST(coalesce(w{k}.label, l{k}.label) AS INTEGER) AS label FROM l{k} LEFT JOIN w{k} ON a = key AND r = 1)")
    return ", ".join(parts)


@register("q29_label_propagation", f"{_lpa_sql(3)} SELECT key, label FROM l3")
def q29(spark, sf_dir):
    return analytics.label_propagation(*people(spark, sf_dir), SHARDS, 3)


_MIGRATE = f"""{_lpa_sql(2)}, sizes AS (SELECT label, count(*) AS size FROM l2 GROUP BY 1),
ranked AS (SELECT label, CAST((row_number() OVER (ORDER BY size DESC, label) - 1) % {SHARDS} AS INTEGER) AS to_shard FROM sizes),
target AS (SELECT l0.key, l0.label AS from_shard, to_shard FROM l0 JOIN l2 ON l2.key = l0.key JOIN ranked ON ranked.label = l2.label)"""


@register("q30_migration_plan", f"{_MIGRATE} SELECT CAST(count(*) FILTER (a.from_shard <> b.from_shard) AS BIGINT) AS current_cuts, CAST(count(*) FILTER (a.to_shard <> b.to_shard) AS BIGINT) AS projected_cuts, (SELECT count(*) FROM ranked) AS communities, (SELECT count(*) FROM target WHERE from_shard <> to_shard) AS moves FROM named JOIN target a ON a.key = src JOIN target b ON b.key = dst")
def q30(spark, sf_dir):
    return analytics.migration_plan(*people(spark, sf_dir), SHARDS, 2).summary


def steps(spark, sf_dir):
    e = analytics.sharded_edges(people(spark, sf_dir)[1], SHARDS)
    return e.select(F.col("src_shard").alias("from_shard"), F.col("dst_shard").alias("to_shard"))


@register("q31_crossings_topn", f"{_S} SELECT a AS from_shard, b AS to_shard, count(*) AS crossings FROM sharded WHERE a <> b GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 5")
def q31(spark, sf_dir):
    return analytics.crossings(steps(spark, sf_dir), 5)


@register("q31b_colocation", f"{_S}, hot AS (SELECT a, b, count(*) AS n FROM sharded WHERE a <> b GROUP BY 1, 2 HAVING count(*) >= 10) SELECT a AS from_shard, b AS to_shard, n AS crossings, 'n' || CAST(a % 2 AS VARCHAR) AS from_node, 'n' || CAST(b % 2 AS VARCHAR) AS to_node FROM hot WHERE a % 2 <> b % 2")
def q31b(spark, sf_dir):
    primaries = spark.range(SHARDS).select(F.col("id").cast("int").alias("shard"), F.concat(F.lit("n"), (F.col("id") % 2).cast("string")).alias("node"))
    return analytics.colocation(steps(spark, sf_dir), primaries, 10)


_STUB = f"""{P}, rows AS (SELECT name, CASE WHEN id % 3 = 0 THEN NULL ELSE age END AS age, CASE WHEN id % 4 = 0 THEN NULL ELSE city END AS city FROM person
UNION ALL SELECT name, NULL, NULL FROM person WHERE id % 2 = 0 UNION ALL SELECT name, age, NULL FROM person WHERE id % 6 = 0)"""


@register("q32_dedup_stubs", f"{_STUB}, c AS (SELECT *, (age IS NOT NULL)::INT + (city IS NOT NULL)::INT AS n FROM rows), m AS (SELECT *, max(n) OVER (PARTITION BY name) AS most FROM c) SELECT name, age, city FROM m WHERE n = most")
def q32(spark, sf_dir):
    p = social_graph(spark, sf_dir).node("Person").df
    when = lambda c, k: F.when(F.col("id") % k != 0, F.col(c)).alias(c)
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    rows = p.select("name", when("age", 3), when("city", 4)).unionByName(p.where("id % 2 = 0").select("name", null("age", "long"), null("city", "string"))).unionByName(p.where("id % 6 = 0").select("name", "age", null("city", "string")))
    return dedup_stubs(rows, "name")


@register("q32b_bloom_likely", f"{P} SELECT count(*) AS found FROM person")
def q32b(spark, sf_dir):
    keys = people(spark, sf_dir)[0]
    m, k = bloom.sizes(max(1, keys.count()), 0.01)
    likely = bloom.likely_shards(bloom.build(keys, SHARDS, m, k), keys, m, k)
    from .functions.hashing import shard

    return likely.where(F.col("shard") == shard(F.col("key"), SHARDS)).agg(F.count("*").alias("found"))


@register("q32c_frontier_hops", f"{PK}, a AS (SELECT DISTINCT dst FROM named WHERE src IN ('{A7}', 'Customer#000000009')), b AS (SELECT DISTINCT n.dst FROM named n JOIN a ON n.src = a.dst) SELECT dst AS key FROM b")
def q32c(spark, sf_dir):
    edges = social_graph(spark, sf_dir).rel("KNOWS").df.select(F.col("_src").alias("_from"), F.col("_dst").alias("_to"))
    start = spark.createDataFrame([(A7,), ("Customer#000000009",)], "_key string")
    return paths.frontier_hops(start, [edges, edges]).select(F.col("_key").alias("key"))


@register("q32d_fnv_hash", f"{P} SELECT name, CAST({FNV.format(k='name')} AS BIGINT) AS h FROM person")
def q32d(spark, sf_dir):
    from .functions.hashing import fnv1a32

    return people(spark, sf_dir)[0].select(F.col("key").alias("name"), fnv1a32(F.col("key")).alias("h"))


# ---------------------------------------------------------------- writes


def after(*statements: str, show: str = "MATCH (p:Person) RETURN p.name AS name, p.age AS age, p.city AS city"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        for s in statements:
            e.cypher(s)
        return e.cypher(show)

    return run


QUERIES["q33_create"] = after("CREATE (n:Person {name: 'New One', age: 33, city: 'HERE'})")
ORACLE_SQL["q33_create"] = f"{P} SELECT name, age, city FROM person UNION ALL SELECT 'New One', 33, 'HERE'"
QUERIES["q34_merge_upsert"] = after(f"MERGE (n:Person {{name: '{A7}'}}) ON CREATE SET n.age = 1 ON MATCH SET n.age = n.age + 100", "MERGE (n:Person {name: 'New Two'}) ON CREATE SET n.age = 1 ON MATCH SET n.age = 2")
ORACLE_SQL["q34_merge_upsert"] = f"{P} SELECT name, CASE WHEN name = '{A7}' THEN age + 100 ELSE age END AS age, city FROM person UNION ALL SELECT 'New Two', 1, NULL"
QUERIES["q35_set"] = after("MATCH (n:Person) WHERE n.age > 70 SET n.city = 'OLD', n.age = n.age - 1")
ORACLE_SQL["q35_set"] = f"{P} SELECT name, CASE WHEN age > 70 THEN age - 1 ELSE age END AS age, CASE WHEN age > 70 THEN 'OLD' ELSE city END AS city FROM person"
QUERIES["q36_remove"] = after("MATCH (n:Person) WHERE n.city = 'BUILDING' REMOVE n.age")
ORACLE_SQL["q36_remove"] = f"{P} SELECT name, CASE WHEN city = 'BUILDING' THEN NULL ELSE age END AS age, city FROM person"
QUERIES["q37_detach_delete"] = after("MATCH (n:Person) WHERE n.age = 50 DETACH DELETE n", show="MATCH (a:Person)-[r:KNOWS]->(b:Person) RETURN a.name AS a, count(r) AS n")
ORACLE_SQL["q37_detach_delete"] = f"{PK} SELECT src AS a, count(*) AS n FROM named JOIN person x ON x.name = src JOIN person y ON y.name = dst WHERE x.age <> 50 AND y.age <> 50 GROUP BY src"
QUERIES["q37b_create_edge"] = after(f"MATCH (a:Person {{name: '{A7}'}}), (b:Person {{name: 'Customer#000000009'}}) CREATE (a)-[:KNOWS {{since: 1999}}]->(b)", show="MATCH (a:Person)-[r:KNOWS]->(b) WHERE r.since < 2016 RETURN r.since AS since, count(*) AS n")
ORACLE_SQL["q37b_create_edge"] = f"{PK} SELECT since, count(*) AS n FROM named WHERE since < 2016 GROUP BY 1 UNION ALL SELECT 1999, 1"
QUERIES["q37c_delete_rel"] = after("MATCH (a:Person)-[r:KNOWS]->(b:Person) WHERE r.since = 2018 DELETE r", show="MATCH (a:Person)-[r:KNOWS]->(b:Person) RETURN r.since AS since, count(*) AS n")
ORACLE_SQL["q37c_delete_rel"] = f"{PK} SELECT since, count(*) AS n FROM named WHERE since <> 2018 GROUP BY 1"


# ---------------------------------------------------------------- in and out, streams


@register("q38_export_nodes", f"{P} SELECT age, city, id, name FROM person")
def q38(spark, sf_dir):
    return csv_io.export_nodes(social_graph(spark, sf_dir), "Person")


@register("q39_export_edges", f'{PK} SELECT src AS "from", dst AS "to", min(since) AS since FROM named GROUP BY 1, 2')
def q39(spark, sf_dir):
    return csv_io.export_edges(social_graph(spark, sf_dir), "KNOWS")


def _folder(spark: SparkSession) -> str:
    return f"{paths.scratch_folder(spark)}/{uuid.uuid4().hex}"


@register("q40_ingest_events", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def q40(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    queue = IngestQueue(spark, _folder(spark))
    queue.submit("events", events.where("event_id % 2 = 0"))
    queue.submit("events", events.where("event_id % 2 = 1"))
    got = queue.run("events", events.schema)
    return got.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@register("q41_replica_lag", "WITH a AS (SELECT CAST(user_id % 4 AS INTEGER) AS shard_id, 'n' || CAST(user_id % 3 AS VARCHAR) AS node, event_id AS seq FROM events), h AS (SELECT shard_id, max(seq) AS head FROM a GROUP BY 1) SELECT shard_id, node, max(seq) AS position, head, greatest(head - max(seq), 0) AS lag FROM a JOIN h USING (shard_id) GROUP BY shard_id, node, head")
def q41(spark, sf_dir):
    acks = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") % 4).cast("int").alias("shard_id"), F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("node"), F.col("event_id").alias("seq"))
    return changelog.lag(acks, acks.groupBy("shard_id").agg(F.max("seq").alias("head")))


@register("q47_bulk_load", f"{P} SELECT city, count(*) AS n, CAST(sum(age) AS BIGINT) AS ages FROM person GROUP BY 1")
def q47(spark, sf_dir):
    folder = _folder(spark)
    csv_io.write_csv(social_graph(spark, sf_dir).node("Person").df.select("name", "age", "city"), folder)
    e = Engine(spark)
    e.cypher("CREATE NODE TABLE Person(name STRING, age INT64, city STRING, PRIMARY KEY(name))")
    e.cypher(f"COPY Person FROM '{folder}' (HEADER=true)")
    return e.cypher("MATCH (p:Person) RETURN p.city AS city, count(p) AS n, sum(p.age) AS ages")


@register("q59_load_rels", f"{PK} SELECT p.city, count(*) AS n, CAST(sum(since) AS BIGINT) AS s FROM named JOIN person p ON p.name = dst GROUP BY 1")
def q59(spark, sf_dir):
    g, nodes, rels = social_graph(spark, sf_dir), _folder(spark), _folder(spark)
    csv_io.write_csv(g.node("Person").df.select("name", "age", "city"), nodes)
    csv_io.write_csv(csv_io.export_edges(g, "KNOWS", keep_parallel=True), rels)
    e = Engine(spark)
    e.cypher("CREATE NODE TABLE Person(name STRING, age INT64, city STRING, PRIMARY KEY(name))")
    e.cypher("CREATE REL TABLE KNOWS(FROM Person TO Person, since INT64)")
    e.cypher(f"COPY Person FROM '{nodes}' (HEADER=true)")
    e.cypher(f"COPY KNOWS FROM '{rels}' (HEADER=true)")
    return e.cypher("MATCH (:Person)-[r:KNOWS]->(p:Person) RETURN p.city AS city, count(r) AS n, sum(r.since) AS s")


QUERIES["q60_alter"] = after("ALTER TABLE Person ADD grade INT64 DEFAULT 7", "ALTER TABLE Person RENAME city TO town", "ALTER TABLE KNOWS DROP since", show="MATCH (p:Person) RETURN p.town AS town, sum(p.grade) AS grades, COUNT { (p)-[:KNOWS]->(:Person) } > 0 AS knows")
ORACLE_SQL["q60_alter"] = f"{PK} SELECT city AS town, CAST(7 * count(*) AS BIGINT) AS grades, name IN (SELECT src FROM named) AS knows FROM person GROUP BY 1, 3"


@register("q61_ingest_graph", f"{PK} SELECT p.city AS city, count(*) AS n FROM named JOIN person p ON p.name = src GROUP BY 1")
def q61(spark, sf_dir):
    g, queue, e = social_graph(spark, sf_dir), IngestQueue(spark, _folder(spark)), Engine(spark)
    e.cypher("CREATE NODE TABLE Person(name STRING, city STRING, PRIMARY KEY(name))")
    e.cypher("CREATE REL TABLE KNOWS(FROM Person TO Person, since INT64)")
    queue.submit("KNOWS", g.rel("KNOWS").df.select("_src", "_dst", "since"), kind="edges")
    queue.submit("Person", g.node("Person").df.select("name", "city"))
    queue.deliver(e.graph, "KNOWS")  # makes the ends that are not there yet
    queue.deliver(e.graph, "Person")
    return e.cypher("MATCH (p:Person)-[r:KNOWS]->(:Person) RETURN p.city AS city, count(r) AS n")


@register("q62_log_replay", "SELECT * FROM (VALUES ('a', 5, 'X'), ('b', 2, NULL)) t(name, age, city)")
def q62(spark, sf_dir):
    log = changelog.ChangeLog(spark, _folder(spark))
    e = Engine(spark, log=log)
    e.cypher("CREATE NODE TABLE Person(name STRING, age INT64, city STRING, PRIMARY KEY(name))")
    e.cypher("CREATE (p:Person {name: $n, age: 4, city: 'X'})", {"n": "a"})
    e.cypher("MERGE (p:Person {name: 'b'}) ON CREATE SET p.age = 2")
    e.cypher("MATCH (p:Person {name: 'a'}) SET p.age = p.age + 1")
    again = Engine(spark)
    log.replay(again)
    return again.cypher("MATCH (p:Person) RETURN p.name AS name, p.age AS age, p.city AS city")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Friends of friends by city, from one person."""
    return engine(spark, sf_dir).cypher("MATCH (a:Person {name: $name})-[:KNOWS]->(b)-[:KNOWS]->(c:Person) WHERE a.name <> c.name RETURN c.city AS city, count(DISTINCT c) AS people, avg(c.age) AS age ORDER BY city", {"name": A7})
