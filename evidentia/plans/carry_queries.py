"""Values carried forward over few, very long documents made of events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import carry
from ..operators.joins import dealt
from ..sources.tables import table


def carried(s, d):
    """Of each event the last great value of its type, itself included, in order of number."""
    e = table(s, d, "events").select(F.col("event_type").alias("id"), F.col("event_id").alias("pos"), F.when(F.col("value") > 90, F.round("value", 6)).alias("v"))
    return carry.carry_forward(e, "v", 500).select("id", "pos", "carried")


def coverage(s, d):
    """Three reports with a record for each order, which is closed unless the order is; its line items are covered if there are many of the part."""
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_custkey") % 3).alias("id"), (F.col("o_orderkey") * 100).alias("base"))
    l = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    l = dealt(l, l.count(), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    lines = o.select("id", F.col("base").alias("pos"), F.concat(F.lit("SF:orders\\"), F.col("o_orderkey").cast("string")).alias("line"))
    hits = F.when(F.col("q") > 25, F.col("q").cast("int").cast("string")).otherwise("0")
    lines = lines.unionByName(l.select("id", (F.col("base") + F.col("l_linenumber") + 1).alias("pos"), F.concat(F.lit("DA:"), F.col("l_linenumber").cast("string"), F.lit(","), hits).alias("line")))
    lines = lines.unionByName(o.where("o_orderstatus <> 'F'").select("id", (F.col("base") + 99).alias("pos"), F.lit("end_of_record").alias("line")))
    return carry.coverage_records(lines)


QUERIES = {"carried_values": carried, "coverage_records": coverage}
ORACLE_SQL = {
    "carried_values": "SELECT event_type AS id, event_id AS pos, last_value(CASE WHEN value > 90 THEN round(value, 6) END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id) AS carried FROM events",
    "coverage_records": """WITH l AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT o_custkey % 3 AS id, o_orderkey * 100 AS pos, 'orders/' || o_orderkey AS path, count(l_linenumber) AS lines_found, count_if(coalesce(q, 0) > 25) AS lines_hit FROM orders LEFT JOIN l ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' GROUP BY ALL""",
}
