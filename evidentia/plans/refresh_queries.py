"""Degrees and quotient edges of all line items, from the answer without the last year's and those alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import refresh
from ..operators.cuts import cut_table
from ..sources.tables import table

#: What is new since the old answer, and what of the old is gone.
NEW, GONE = "l_shipdate >= '2000-06-01'", "l_returnflag = 'R' and l_shipdate < '1996-01-01'"


def _edges(rows):
    return rows.select(F.concat(F.lit("supplier:"), "l_suppkey").alias("src"), F.concat(F.lit("part:"), "l_partkey").alias("dst"), F.lit("supplies").alias("kind"), F.col("l_returnflag").alias("evidence"))


def _snapshots(s, d):
    """The old rows, signed, and the difference: only rows of it are read for the new answer."""
    l = table(s, d, "lineitem")
    old = _edges(l.where(f"not ({NEW})")).withColumn("sign", F.lit(1).cast("long"))
    return old, refresh.signed(_edges(l.where(GONE)), _edges(l.where(NEW)))


def degrees(s, d):
    old, delta = _snapshots(s, d)
    keys = ["id", "direction"]
    kept = cut_table(refresh.count_all(refresh.degree_keys(old), keys))
    return refresh.refresh_counts(kept, refresh.degree_keys(delta), keys)


def quotient(s, d):
    """Supplier's nation to part's brand, and the census of the same edges."""
    old, delta = _snapshots(s, d)
    owners = table(s, d, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.concat(F.lit("nation:"), "s_nationkey").alias("owner"))
    owners = cut_table(owners.unionByName(table(s, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_brand").alias("owner"))))
    keys = ["src", "dst", "kind"]
    kept = cut_table(refresh.count_all(refresh.quotient_keys(old, owners), keys))
    out = refresh.refresh_counts(kept, refresh.quotient_keys(delta, owners), keys)
    names = ["census", "name"]
    census = refresh.refresh_counts(cut_table(refresh.count_all(refresh.census_keys(old), names)), refresh.census_keys(delta), names)
    return out.unionByName(census.select(F.col("census").alias("src"), F.col("name").alias("dst"), F.lit("census").alias("kind"), "n"))


QUERIES = {"refreshed_degrees": degrees, "refreshed_quotient": quotient}
_NOW = f"e AS (SELECT * FROM lineitem WHERE NOT ({GONE}))"
ORACLE_SQL = {
    "refreshed_degrees": f"WITH {_NOW} SELECT 'supplier:' || l_suppkey AS id, 'out' AS direction, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT 'part:' || l_partkey, 'in', count(*) FROM e GROUP BY ALL",
    "refreshed_quotient": f"""WITH {_NOW} SELECT 'nation:' || s_nationkey AS src, p_brand AS dst, 'supplies' AS kind, count(*) AS n FROM e JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL
UNION ALL SELECT 'relation', 'supplies', 'census', count(*) FROM e UNION ALL SELECT 'evidence', l_returnflag, 'census', count(*) FROM e GROUP BY l_returnflag""",
}
