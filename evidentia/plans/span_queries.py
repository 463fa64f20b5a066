"""Positions, references and symbols over customers as files, orders as spans in days, and parts as symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spans
from ..sources.tables import table


def _day(c):
    return F.datediff(c, F.lit("1995-01-01").cast("date")).cast("long")


def _names(prefix, c):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def occurrences(s, d):
    """What stands at each line item's ship day in one file of a hundred customers: an order is a declaration, a line item a usage of its part."""
    o = table(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("file"), _day("o_orderdate").alias("start"))
    l = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", _day("l_shipdate").alias("ship")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    uses = l.select("file", _names("part:", "l_partkey").alias("symbol"), "start", (F.col("start") + F.col("l_partkey") % 30).alias("end"))
    own = o.select("file", _names("order:", "o_orderkey").alias("symbol"), "start", (F.col("start") + F.col("o_orderkey") % 400).alias("end"))
    return spans.occurrence_at(uses, own, l.select("file", F.col("ship").alias("at")))


def _references(s, d):
    o = table(s, d, "orders").select("o_orderkey", _names("customer:", "o_custkey").alias("file"), _day("o_orderdate").alias("line"))
    l = table(s, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.when(F.col("l_returnflag") == "R", "contains").otherwise("calls")
    return l.select(_names("order:", "l_orderkey").alias("src"), _names("part:", "l_partkey").alias("dst"), kind.alias("kind"), "file", "line", F.col("l_linenumber").alias("column"))


def references(s, d):
    """The second page of ten references to every part."""
    return spans.references_of(table(s, d, "part").select(_names("part:", "p_partkey").alias("symbol")), _references(s, d), offset=10, limit=10)


def symbols(s, d):
    """Every part with its relations, and the lines about the line of its size in the document of its number."""
    p = table(s, d, "part")
    docs = table(s, d, "documents").select(_names("doc:", "doc_id").alias("file"), "text")
    nodes = p.select(_names("part:", "p_partkey").alias("id"), F.col("p_type").alias("kind"), F.col("p_name").alias("label"), _names("doc:", "p_partkey").alias("file"), F.col("p_size").alias("line"))
    out = spans.inspect_symbols(nodes.select(F.col("id").alias("symbol")), nodes, _references(s, d), docs, 2)
    return out.withColumn("relations", F.array_join("relations", ","))


QUERIES = {"occurrence_at_position": occurrences, "references_page": references, "inspect_symbols": symbols}

_DAY = lambda c: f"date_diff('day', DATE '1995-01-01', CAST({c} AS DATE))"
_REFS = f"""r AS (SELECT 'order:' || l_orderkey AS src, 'part:' || l_partkey AS dst, CASE WHEN l_returnflag = 'R' THEN 'contains' ELSE 'calls' END AS kind, 'customer:' || o_custkey AS file, {_DAY('o_orderdate')} AS line, l_linenumber AS col
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
ORACLE_SQL = {
    "occurrence_at_position": f"""WITH o AS (SELECT o_orderkey, o_custkey % 100 AS file, {_DAY('o_orderdate')} AS start FROM orders), l AS MATERIALIZED (SELECT l_orderkey, l_partkey, file, start, {_DAY('l_shipdate')} AS pos FROM lineitem JOIN o ON l_orderkey = o_orderkey),
s AS MATERIALIZED (SELECT DISTINCT file, 0 AS rank, 'part:' || l_partkey AS symbol, start, start + l_partkey % 30 AS stop FROM l UNION ALL SELECT file, 1, 'order:' || o_orderkey, start, start + o_orderkey % 400 FROM o),
p AS (SELECT DISTINCT file, pos FROM l),
m AS (SELECT p.file, p.pos, min({{'area': stop - start, 'rank': rank, 'symbol': symbol, 'start': start}}) AS m FROM p JOIN s ON p.file = s.file AND s.start <= p.pos AND (p.pos < s.stop OR (s.start = s.stop AND p.pos = s.start)) GROUP BY p.file, p.pos)
SELECT file, pos AS "at", CASE WHEN m.rank = 0 THEN 'usage' ELSE 'definition' END AS role, m.symbol AS symbol, m.start AS start, m.start + m.area AS "end" FROM m""",
    "references_page": f"""WITH {_REFS}, u AS (SELECT dst AS symbol, file, line, col, min(src) AS src FROM r WHERE kind = 'calls' GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY file, line, col) AS place, count(*) OVER (PARTITION BY symbol) AS total FROM u)
SELECT symbol, place, total, src, 'calls' AS kind, file, line, col AS "column" FROM n WHERE place BETWEEN 11 AND 20""",
    "inspect_symbols": f"""WITH {_REFS}, c AS (SELECT dst, string_agg('in ' || kind || ' ' || n, ',' ORDER BY kind) AS relations FROM (SELECT dst, kind, count(*) AS n FROM r GROUP BY ALL) GROUP BY dst)
SELECT 'part:' || p_partkey AS symbol, p_type AS kind, p_name AS label, coalesce(relations, '') AS relations, array_to_string(string_split(text, chr(10))[greatest(1, p_size - 2) : p_size + 2], chr(10)) AS source
FROM part LEFT JOIN documents ON doc_id = p_partkey LEFT JOIN c ON dst = 'part:' || p_partkey""",
}
