"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one line of JSON. Seconds are the best of three."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = f"{sys.path[0]}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from lattica.engine import Engine  # noqa: E402
from lattica.operators import analytics  # noqa: E402
from lattica.sources.csv_io import write_csv  # noqa: E402
from lattica.sources.tables import social_graph  # noqa: E402

A = "Customer#000000007"
CYPHER = {
    "point_lookup": f"MATCH (p:Person {{name: '{A}'}}) RETURN p.name, p.age, p.city",
    "range_filter": "MATCH (p:Person) WHERE p.city = 'BUILDING' AND p.age > 40 RETURN p.name, p.age LIMIT 20",
    "count_all_nodes": "MATCH (p:Person) RETURN count(p)",
    "count_filtered": "MATCH (p:Person) WHERE p.city = 'BUILDING' RETURN count(p)",
    "aggregate_avg_age": "MATCH (p:Person) WHERE p.city = 'BUILDING' RETURN avg(p.age), min(p.age), max(p.age)",
    "group_by_city": "MATCH (p:Person) RETURN p.city, count(p) AS n, avg(p.age) ORDER BY n DESC",
    "1_hop": f"MATCH (a:Person {{name: '{A}'}})-[:KNOWS]->(b) RETURN b.name LIMIT 10",
    "2_hop": f"MATCH (a:Person {{name: '{A}'}})-[:KNOWS]->(b)-[:KNOWS]->(c) RETURN b.name, c.name LIMIT 20",
    "var_length_1_3": f"MATCH (a:Person {{name: '{A}'}})-[:KNOWS*1..3]->(b:Person) RETURN DISTINCT b.name LIMIT 20",
    "friend_of_friend_count": f"MATCH (a:Person {{name: '{A}'}})-[:KNOWS]->(b)-[:KNOWS]->(c) WHERE a.name <> c.name RETURN count(DISTINCT c)",
    "mutual_friends": f"MATCH (a:Person {{name: '{A}'}})-[:KNOWS]->(m)<-[:KNOWS]-(b:Person {{name: 'Customer#000000009'}}) RETURN m.name LIMIT 10",
    "shortest_path": f"MATCH (a:Person {{name: '{A}'}})-[r:KNOWS* SHORTEST 1..6]->(b:Person {{name: 'Customer#000000042'}}) RETURN length(r)",
    "all_fof_by_city": "MATCH (a:Person)-[:KNOWS]->(b)-[:KNOWS]->(c) RETURN a.city, c.city, count(*)",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark)
    g = engine.databases._graphs["default"] = social_graph(spark, folder)
    for t in (*g.nodes, *g.rels):  # a loaded database
        g.bind(t.name, t.df.cache())
        g.node(t.name).df.count() if t in g.nodes else g.rel(t.name).df.count()
    seconds: dict[str, float] = {}

    def clock(name: str, run, times: int = 3) -> None:
        best = float("inf")
        for _ in range(times):
            begun = time.perf_counter()
            run()
            best = min(best, time.perf_counter() - begun)
        seconds[name] = round(best, 4)

    for name, text in CYPHER.items():
        clock(name, lambda text=text: engine.cypher(text).collect())
    nodes = g.node("Person").df.select(F.col("name").alias("key"))
    edges = g.rel("KNOWS").df.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))
    clock("locality", lambda: analytics.locality(edges, 12).collect())
    clock("label_propagation_3", lambda: analytics.label_propagation(nodes, edges, 12, 3).count(), 1)
    clock("single_write", lambda: engine.cypher(f"CREATE (n:Person {{name: 'w{time.time_ns()}', age: 1, city: 'X'}})"), 2)
    clock("merge_upsert", lambda: engine.cypher(f"MERGE (n:Person {{name: '{A}'}}) ON MATCH SET n.age = 50"), 2)
    at = f"{tempfile.mkdtemp()}/people"
    write_csv(social_graph(spark, folder).node("Person").df.select("name", "age", "city"), at)

    def bulk() -> None:
        e = Engine(spark)
        e.cypher("CREATE NODE TABLE Person(name STRING, age INT64, city STRING, PRIMARY KEY(name))")
        e.cypher(f"COPY Person FROM '{at}' (HEADER=true)")

    clock("bulk_nodes", bulk, 2)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
