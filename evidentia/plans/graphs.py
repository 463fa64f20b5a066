"""Graphs derived from the tables: nodes(id, kind, label, path), edges(src, dst, kind, evidence)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table

#: kind of edge -> how it was established.
EVIDENCE = {"contains": "parsed", "places": "parsed", "includes": "resolved", "fulfilled_by": "resolved", "supplies": "resolved"}
#: Rows of a table that one task makes distinct; there are as many tasks as rows ask for.
DEALT = 250_000


def _distinct(d: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Distinct rows of columns, dealt so that a task's memory does not grow with the table."""
    n = -(-d.count() // DEALT)
    d = d.select(*columns)
    return (d.repartition(n, *columns) if n > 1 else d).distinct()


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def fk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    region = t("region").select("r_regionkey", "r_name")
    nation = t("nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.concat_ws("/", "r_name", "n_name").alias("np"))
    def under(name, p, label):
        d = t(name).join(nation, F.col(f"{p}_nationkey") == F.col("n_nationkey"))
        key = {"c": "c_custkey", "s": "s_suppkey"}[p]
        return d.select(_id(name, key).alias("id"), F.lit(name).alias("kind"), F.col(label).alias("label"), F.concat_ws("/", "np", label).alias("path"))
    parts = [
        region.select(_id("region", "r_regionkey").alias("id"), F.lit("region").alias("kind"), F.col("r_name").alias("label"), F.col("r_name").alias("path")),
        nation.select(_id("nation", "n_nationkey").alias("id"), F.lit("nation").alias("kind"), F.col("n_name").alias("label"), F.col("np").alias("path")),
        under("customer", "c", "c_name"),
        under("supplier", "s", "s_name"),
        t("part").select(_id("part", "p_partkey").alias("id"), F.lit("part").alias("kind"), F.col("p_name").alias("label"), F.concat_ws("/", "p_brand", "p_name").alias("path")),
        t("orders").select(_id("order", "o_orderkey").alias("id"), F.lit("order").alias("kind"), F.col("o_orderpriority").alias("label"), F.lit("orders").alias("path")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: table, its columns to make distinct (none: rows are edges), relation, source and target (kind, key).
RELATIONS = [
    ("nation", (), "contains", ("region", "n_regionkey"), ("nation", "n_nationkey")),
    ("customer", (), "contains", ("nation", "c_nationkey"), ("customer", "c_custkey")),
    ("supplier", (), "contains", ("nation", "s_nationkey"), ("supplier", "s_suppkey")),
    ("orders", (), "places", ("customer", "o_custkey"), ("order", "o_orderkey")),
    ("lineitem", ("l_orderkey", "l_partkey"), "includes", ("order", "l_orderkey"), ("part", "l_partkey")),
    ("lineitem", ("l_orderkey", "l_suppkey"), "fulfilled_by", ("order", "l_orderkey"), ("supplier", "l_suppkey")),
    ("lineitem", ("l_suppkey", "l_partkey"), "supplies", ("supplier", "l_suppkey"), ("part", "l_partkey")),
]


def fk_edges(spark: SparkSession, sf_dir: str, node: str | None = None) -> DataFrame:
    """All edges, or those of one node: its key then goes to the scans as a typed filter, before ids are built."""
    out = None
    kind_, _, key = (node or "").partition(":")
    for name, distinct, kind, a, b in RELATIONS:
        d = table(spark, sf_dir, name)
        if node:
            ends = [F.col(c) == F.lit(int(key)).cast(d.schema[c].dataType) for k, c in (a, b) if k == kind_]
            if not ends:
                continue
            d = d.where(reduce(or_, ends))
        d = (d.select(*distinct).distinct() if node else _distinct(d, distinct)) if distinct else d
        e = d.select(_id(*a).alias("src"), _id(*b).alias("dst"), F.lit(kind).alias("kind"), F.lit(EVIDENCE[kind]).alias("evidence"))
        out = e if out is None else out.unionByName(e)
    return out


def basket_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer - part pairs of all orders."""
    d = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return d.select(_id("customer", "o_custkey").alias("src"), _id("part", "l_partkey").alias("dst")).distinct()


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nation -> the two other nations that most of its line items come from, ties by name."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("src"))
    p = table(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("dst"))
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = l.groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("k")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(p, F.col("l_suppkey") == F.col("s_suppkey"))
    weight = pairs.groupBy("src", "dst").agg(F.sum("k").alias("weight")).where("src <> dst")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return weight.withColumn("r", rank).where("r <= 2").select("src", "dst", F.lit("trades").alias("kind"), "weight")


def swap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least part of an order -> its greatest one in orders of even number, the other way in odd ones, for two orders of eleven: a graph with cycles."""
    l = table(spark, sf_dir, "lineitem").where("l_orderkey % 11 < 2").groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b")).where("a < b")
    even = F.col("l_orderkey") % 2 == 0
    return l.select(F.when(even, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(even, F.col("b")).otherwise(F.col("a")).alias("dst")).distinct()


#: The same graphs in SQL.
NODES_SQL = """fk_nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'region' AS kind, r_name AS label, r_name AS path FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, r_name || '/' || n_name || '/' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, r_name || '/' || n_name || '/' || s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, p_brand || '/' || p_name FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'order', o_orderpriority, 'orders' FROM orders)"""
EDGES_SQL = """fk_edges AS (
  SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'contains' AS kind, 'parsed' AS evidence FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains', 'parsed' FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains', 'parsed' FROM supplier
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'places', 'parsed' FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'includes', 'resolved' FROM lineitem
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'fulfilled_by', 'resolved' FROM lineitem
  UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'supplies', 'resolved' FROM lineitem)"""
TRADE_SQL = """trade AS (SELECT src, dst, 'trades' AS kind FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM (
  SELECT nc.n_name AS src, ns.n_name AS dst, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation nc ON c_nationkey = nc.n_nationkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ns ON s_nationkey = ns.n_nationkey WHERE nc.n_name <> ns.n_name GROUP BY 1, 2)) WHERE r <= 2)"""
SWAP_SQL = """swaps AS MATERIALIZED (SELECT DISTINCT CASE WHEN l_orderkey % 2 = 0 THEN a ELSE b END AS src, CASE WHEN l_orderkey % 2 = 0 THEN b ELSE a END AS dst FROM
  (SELECT l_orderkey, min(l_partkey) AS a, max(l_partkey) AS b FROM lineitem WHERE l_orderkey % 11 < 2 GROUP BY 1) WHERE a < b)"""
