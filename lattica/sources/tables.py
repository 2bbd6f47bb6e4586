"""The property graph over a folder of star-schema Parquet tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..catalog import GraphCatalog


def social_graph(spark: SparkSession, folder: str, by_id: bool = False) -> GraphCatalog:
    """(:Person {name, age, city, id})-[:KNOWS {since}]->(:Person), from customers and orders.

    The key is name, and so are the ends of KNOWS, or else id: then no customer is joined to make them.
    """
    c = spark.read.parquet(f"{folder}/customer.parquet")
    o = spark.read.parquet(f"{folder}/orders.parquet")
    n = c.count()
    g = GraphCatalog(spark)
    person = c.select(F.col("c_name").alias("name"), (18 + F.col("c_custkey") % 62).cast("long").alias("age"), F.col("c_mktsegment").alias("city"), F.col("c_custkey").alias("id"))
    g.add_node("Person", person, "id" if by_id else "name")
    dst = F.col("o_orderkey") % n
    ends = o.where(F.col("o_custkey") != dst).select(F.col("o_custkey").alias("_src"), dst.alias("_dst"), (2015 + F.col("o_orderkey") % 11).cast("long").alias("since"))
    if not by_id:
        names = lambda k: c.select(F.col("c_custkey").alias(k), F.col("c_name").alias(f"{k}_name"))
        ends = ends.join(names("_src"), "_src").join(names("_dst"), "_dst").select(F.col("_src_name").alias("_src"), F.col("_dst_name").alias("_dst"), "since")
    g.add_rel("KNOWS", ends, "Person", "Person")
    return g


def trade_graph(spark: SparkSession, folder: str) -> GraphCatalog:
    """Customers, suppliers, parts, orders, nations and regions, and what relates them."""
    read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
    g = GraphCatalog(spark)
    for label, table, key in (("Customer", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey"), ("Part", "part", "p_partkey"), ("Orders", "orders", "o_orderkey"), ("Nation", "nation", "n_nationkey"), ("Region", "region", "r_regionkey")):
        g.add_node(label, read(table), key)

    def rel(name, table, src, dst, a, b, *props):
        g.add_rel(name, read(table).select(F.col(src).alias("_src"), F.col(dst).alias("_dst"), *props), a, b)

    rel("LIVES_IN", "customer", "c_custkey", "c_nationkey", "Customer", "Nation")
    rel("BASED_IN", "supplier", "s_suppkey", "s_nationkey", "Supplier", "Nation")
    rel("IN_REGION", "nation", "n_nationkey", "n_regionkey", "Nation", "Region")
    rel("PLACED", "orders", "o_custkey", "o_orderkey", "Customer", "Orders", "o_totalprice", "o_orderdate")
    rel("CONTAINS", "lineitem", "l_orderkey", "l_partkey", "Orders", "Part", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    rel("SUPPLIES", "lineitem", "l_suppkey", "l_partkey", "Supplier", "Part")
    return g
