"""Graph questions asked of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flow, graph
from ..sources.tables import table
from .graphs import EDGES_SQL, NODES_SQL, basket_edges, fk_edges, fk_nodes

BOTH = f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}"


def _ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _region_edges(s, d):
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    c = table(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("src"))
    p = table(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("dst"))
    l = table(s, d, "lineitem").select("l_orderkey", "l_suppkey").join(table(s, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    # Both dimension joins follow a partial count per (customer, supplier).
    return l.groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("k")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(p, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("src", "dst").agg(F.sum("k").alias("weight"))


def _on_cycles(edges):
    """(id, component) of nodes on a cycle: those of components of several, and those with an edge to themselves."""
    c = flow.strong_components(edges)
    loops = edges.where("src = dst").select(F.col("src").alias("id")).distinct().withColumn("loop", F.lit(True))
    many = c.groupBy("component").agg(F.count("*").alias("n"))
    return c.join(many, "component").join(loops, "id", "left").where("n > 1 or loop").select("id", "component")


def _snapshot(s, d, year):
    o = table(s, d, "orders").where(f"o_orderdate < '{year}-01-01'")
    n = lambda c: F.concat(F.lit(f"{c}:"), F.col({"customer": "o_custkey", "priority": "o_orderpriority"}[c]).cast("string"))
    return o.groupBy(n("customer").alias("src"), n("priority").alias("dst")).agg(F.max("o_orderstatus").alias("evidence")).withColumn("kind", F.lit("ordered"))


_SNAP = "SELECT 'customer:' || o_custkey AS src, 'priority:' || o_orderpriority AS dst, max(o_orderstatus) AS evidence FROM orders WHERE o_orderdate < '{}-01-01' GROUP BY 1, 2"
QUERIES = {
    "graph_stats": lambda s, d: graph.census(fk_nodes(s, d), fk_edges(s, d)),
    "node_degrees": lambda s, d: fk_nodes(s, d).join(graph.degrees(fk_edges(s, d)), "id", "left").select("id", "label", F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree"), F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree")),
    "hub_ranking": lambda s, d: graph.hubs(fk_edges(s, d), ("region", "nation"), 10),
    "neighbors_page": lambda s, d: graph.neighbours(fk_edges(s, d, "supplier:1"), "supplier:1", (), 2, 20),
    "khop_forward": lambda s, d: graph.khop(fk_edges(s, d), _ids(s, "customer:1", "customer:2"), 3),
    "khop_dependents": lambda s, d: graph.khop(fk_edges(s, d), _ids(s, "part:1"), 2, reverse=True, blocked=("nation", "region")).where("distance > 0"),
    "shortest_path": lambda s, d: graph.shortest_path(fk_edges(s, d), "region:1", "part:7"),
    # Over all orders: no SQL of ours could stand the closure of whole tables, so tests compare these with brute force.
    "weak_components": lambda s, d: graph.weak_components(basket_edges(s, d)),
    "connectivity_communities": lambda s, d: graph.weak_components(basket_edges(s, d)).groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(20),
    "module_rollup_depth1": lambda s, d: graph.module_rollup(fk_nodes(s, d), 1, 25),
    "module_rollup_depth2": lambda s, d: graph.module_rollup(fk_nodes(s, d), 2, 25),
    "quotient_edges": _region_edges,
    "region_cycles": lambda s, d: _on_cycles(_region_edges(s, d)),
    "graph_diff_edges": lambda s, d: graph.diff_edges(_snapshot(s, d, 1997), _snapshot(s, d, 1998)),
    "graph_diff_totals": lambda s, d: graph.diff_edges(_snapshot(s, d, 1997), _snapshot(s, d, 1998)).groupBy("dst", "change").agg(F.count("*").alias("n")),
}


def _reach(seed: str, depth: int, a: str, b: str, extra: str = "") -> str:
    return f"""{BOTH}, walk(id, distance) AS (SELECT id, CAST(0 AS BIGINT) FROM ({seed}) s UNION
  SELECT e.{b}, w.distance + 1 FROM walk w JOIN fk_edges e ON e.{a} = w.id WHERE w.distance < {depth} {extra})"""


_QUOTIENT = """q AS (SELECT rc.r_name AS src, rs.r_name AS dst, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation nc ON c_nationkey = nc.n_nationkey JOIN region rc ON nc.n_regionkey = rc.r_regionkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ns ON s_nationkey = ns.n_nationkey JOIN region rs ON ns.n_regionkey = rs.r_regionkey GROUP BY 1, 2)"""
_DIFF = f"""WITH x AS ({_SNAP.format(1997)}), y AS ({_SNAP.format(1998)}), j AS (
  SELECT coalesce(x.src, y.src) AS src, coalesce(x.dst, y.dst) AS dst, 'ordered' AS kind,
  CASE WHEN x.src IS NULL THEN 'added' WHEN y.src IS NULL THEN 'removed' WHEN x.evidence <> y.evidence THEN 'changed' END AS change
  FROM x FULL JOIN y ON x.src = y.src AND x.dst = y.dst) """
ORACLE_SQL = {
    "graph_stats": f"""{BOTH} SELECT 'node_kind' AS census, kind AS name, count(*) AS n FROM fk_nodes GROUP BY kind
UNION ALL SELECT 'relation', kind, count(*) FROM fk_edges GROUP BY kind UNION ALL SELECT 'evidence', evidence, count(*) FROM fk_edges GROUP BY evidence""",
    "node_degrees": f"""{BOTH}, o AS (SELECT src, count(*) n FROM fk_edges GROUP BY src), i AS (SELECT dst, count(*) n FROM fk_edges GROUP BY dst)
SELECT id, label, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM fk_nodes LEFT JOIN o ON src = id LEFT JOIN i ON dst = id""",
    "hub_ranking": f"""{BOTH}, u AS (SELECT src AS id, 1 AS o, 0 AS i FROM fk_edges UNION ALL SELECT dst, 0, 1 FROM fk_edges)
SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, count(*) AS degree FROM u
WHERE id NOT LIKE 'region:%' AND id NOT LIKE 'nation:%' GROUP BY id ORDER BY degree DESC, id LIMIT 10""",
    "neighbors_page": f"""{BOTH}, b AS (SELECT 'out' AS direction, dst AS id, kind, evidence FROM fk_edges WHERE src = 'supplier:1'
UNION ALL SELECT 'in', src, kind, evidence FROM fk_edges WHERE dst = 'supplier:1')
SELECT *, (SELECT count(*) FROM b) AS total FROM b ORDER BY direction DESC, id, kind LIMIT 20 OFFSET 2""",
    "khop_forward": _reach("SELECT 'customer:1' AS id UNION SELECT 'customer:2'", 3, "src", "dst") + " SELECT id, min(distance) AS distance FROM walk GROUP BY id",
    "khop_dependents": _reach("SELECT 'part:1' AS id", 2, "dst", "src", "AND w.id NOT LIKE 'nation:%' AND w.id NOT LIKE 'region:%'") + " SELECT id, min(distance) AS distance FROM walk GROUP BY id HAVING min(distance) > 0",
    "shortest_path": f"""{BOTH}, f(id, k) AS (SELECT 'region:1', CAST(0 AS BIGINT) UNION SELECT e.dst, k + 1 FROM f JOIN fk_edges e ON e.src = f.id WHERE k < 8),
b(id, k) AS (SELECT 'part:7', CAST(0 AS BIGINT) UNION SELECT e.src, k + 1 FROM b JOIN fk_edges e ON e.dst = b.id WHERE k < 8),
x AS (SELECT id, min(k) AS k FROM f GROUP BY id), y AS (SELECT id, min(k) AS k FROM b GROUP BY id)
SELECT x.k + 1 AS hop, src, dst, kind, evidence FROM fk_edges JOIN x ON src = x.id JOIN y ON dst = y.id WHERE x.k + y.k + 1 = (SELECT k FROM x WHERE id = 'part:7')""",
    "module_rollup_depth1": f"{BOTH} SELECT split_part(path, '/', 1) AS prefix, count(*) AS n, count(DISTINCT kind) AS kinds FROM fk_nodes GROUP BY 1 ORDER BY n DESC, prefix LIMIT 25",
    "module_rollup_depth2": f"{BOTH} SELECT array_to_string(string_split(path, '/')[1:2], '/') AS prefix, count(*) AS n, count(DISTINCT kind) AS kinds FROM fk_nodes GROUP BY 1 ORDER BY n DESC, prefix LIMIT 25",
    "quotient_edges": f"WITH {_QUOTIENT} SELECT src, dst, weight FROM q",
    "region_cycles": f"WITH RECURSIVE {_QUOTIENT}, r(src, dst) AS (SELECT src, dst FROM q UNION SELECT r.src, q.dst FROM r JOIN q ON r.dst = q.src) SELECT a.src AS id, min(least(a.src, a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY 1",
    "graph_diff_edges": _DIFF + "SELECT src, dst, kind, change FROM j WHERE change IS NOT NULL",
    "graph_diff_totals": _DIFF + "SELECT dst, change, count(*) AS n FROM j WHERE change IS NOT NULL GROUP BY 1, 2",
}
