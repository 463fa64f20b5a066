"""Changes between snapshots, their impact, findings, and measurement series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import change, measure, source
from ..operators.cuts import cut
from ..sources.tables import table
from .graph_queries import _DIFF, _snapshot
from .graphs import EDGES_SQL, fk_edges
from ..operators.graph import diff_edges

#: Line rules of the audit: name, severity, pattern.
LINE_RULES = [("text.digit_run", "high", "[0-9]{12,}"), ("text.mark_noise", "medium", "%%%|###|[*]{3}"), ("text.address", "high", "[a-z0-9]@[a-z0-9]"), ("text.trailing_blank", "low", " $")]


def _customers(s, d, year: int):
    o = table(s, d, "orders").where(F.col("o_orderdate") < F.lit(f"{year}-01-01").cast("timestamp_ntz"))
    return o.groupBy(F.concat(F.lit("customer:"), "o_custkey").alias("id")).agg(F.count("*").alias("orders_count"))


def _declarations(s, d):
    """Parts as declarations before and after an edit: some ids, labels, paths and bodies differ, some are gone."""
    p = table(s, d, "part")
    k, label, path, body = F.col("p_partkey"), F.col("p_name"), F.col("p_brand"), F.round(F.col("p_retailprice") * 100).cast("long").cast("string")
    at = lambda n: k % n == 0
    before = p.select(F.concat(F.lit("part:"), k).alias("id"), label.alias("label"), F.col("p_type").alias("kind"), path.alias("path"), body.alias("print"))
    after = p.where(k % 13 != 0).select(
        F.concat(F.when(at(7), F.lit("moved:")).otherwise(F.lit("part:")), k).alias("id"), F.when(at(11), F.concat(label, F.lit(" new"))).otherwise(label).alias("label"), F.col("p_type").alias("kind"),
        F.when(at(5), F.lit("other")).otherwise(path).alias("path"), F.when(at(3), F.concat(body, F.lit("x"))).otherwise(body).alias("print"),
    )
    return before, after


def classification(s, d):
    before, after = _declarations(s, d)
    return change.classify_pairs(change.pair_declarations(before, after), before, after)


SEEDS = ("part:7", "part:14", "part:21")


def impact(s, d):
    seeds = s.createDataFrame([(x,) for x in SEEDS], "id string")
    return change.impact(fk_edges(s, d), seeds, 2, ("includes", "supplies", "fulfilled_by", "places"))


def selected(s, d):
    """Customers with a key that ends in 7 stand for checks; one bears a changed part's number, one changed itself."""
    is_check = F.col("check").rlike("^customer:.*7$")
    hits = impact(s, d).select(F.col("id").alias("check"), "seed", "distance").where(is_check)
    named = s.createDataFrame([("customer:7", "part:7")], "check string, seed string")
    return change.select_checks(hits, named, s.createDataFrame([("customer:17",)], "check string"), 50)


def _audit(s, d, text):
    return source.line_findings(table(s, d, "documents").select(F.col("doc_id").alias("id"), text.alias("text")), LINE_RULES, "medium")


def debt(s, d):
    """Findings in the texts against those in an earlier form of them, which had other marks."""
    earlier = F.regexp_replace(F.regexp_replace("text", "%%%", "%"), "[.]\n", "###\n")
    return change.partition_findings(_audit(s, d, F.col("text")), _audit(s, d, earlier)).groupBy("status").agg(F.count("*").alias("n"))


def hot_parts(s, d):
    l = table(s, d, "lineitem")
    changes = l.groupBy(F.col("l_partkey").alias("path")).agg(F.count_distinct("l_orderkey").alias("changes"))
    degrees = l.select("l_partkey", "l_suppkey").distinct().groupBy(F.col("l_partkey").alias("path")).agg(F.count("*").alias("degree"))
    return change.hotspots(changes, degrees, 20)


def _daily(s, d):
    e = table(s, d, "events").groupBy("event_type", F.to_date("ts").alias("day"))
    return e.agg((F.sum(F.col("value").cast("decimal(18,4)")).cast("double") / F.count("value")).alias("value")).withColumn("revision", F.col("day").cast("string"))


def by_symbol(s, d):
    """Daily means by event type are the series; the users with events of a type on a day are what changed in its step."""
    steps = measure.steps(_daily(s, d), "event_type", "day", 5.0)
    changed = table(s, d, "events").select("event_type", F.to_date("ts").alias("day"), F.col("user_id").alias("symbol"))
    return measure.credit(steps, changed, ["event_type", "day"])


def noise(s, d):
    """Single events are the points and their days the revisions, so a day measures one revision again and again."""
    points = table(s, d, "events").select("event_type", "event_id", F.to_date("ts").cast("string").alias("revision"), "value")
    return measure.noise_floor(measure.steps(points, "event_type", "event_id", 5.0), "event_type")


QUERIES = {
    "graph_diff_nodes": lambda s, d: change.diff_nodes(_customers(s, d, 1997), _customers(s, d, 1998), ["orders_count"]),
    "graph_diff_churn": lambda s, d: change.churn(diff_edges(_snapshot(s, d, 1997), _snapshot(s, d, 1998)), ["dst"]),
    "change_classification": classification, "change_impact": impact, "select_affected": selected,
    "audit_line_rules": lambda s, d: _audit(s, d, F.col("text")), "audit_debt_partition": debt, "hotspot_scores": hot_parts,
    "perf_last_points": lambda s, d: measure.last_points(_daily(s, d), "event_type", "day", 7).select("event_type", "revision", F.round("value", 6).alias("value")),
    "perf_by_symbol": by_symbol, "perf_noise_floor": noise,
}

_C = "SELECT 'customer:' || o_custkey AS id, count(*) AS orders_count FROM orders WHERE o_orderdate < TIMESTAMP '{}-01-01' GROUP BY 1"
_BODY = "CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS VARCHAR)"
_PAIRS = f"""WITH b AS (SELECT 'part:' || p_partkey AS id, p_name AS label, p_type AS kind, p_brand AS path, {_BODY} AS print FROM part),
a AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'moved:' ELSE 'part:' END || p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN p_name || ' new' ELSE p_name END AS label, p_type AS kind,
  CASE WHEN p_partkey % 5 = 0 THEN 'other' ELSE p_brand END AS path, CASE WHEN p_partkey % 3 = 0 THEN {_BODY} || 'x' ELSE {_BODY} END AS print FROM part WHERE p_partkey % 13 <> 0),
s1 AS (SELECT b.id AS before_id, a.id AS after_id, 'id' AS stage FROM b JOIN a USING (id)),
b1 AS (SELECT * FROM b WHERE id NOT IN (SELECT before_id FROM s1)), a1 AS (SELECT * FROM a WHERE id NOT IN (SELECT after_id FROM s1)),
s2 AS (SELECT x.id AS before_id, y.id AS after_id, 'declaration' AS stage FROM (SELECT label, kind, path, min(id) AS id FROM b1 GROUP BY 1, 2, 3 HAVING count(*) = 1) x
  JOIN (SELECT label, kind, path, min(id) AS id FROM a1 GROUP BY 1, 2, 3 HAVING count(*) = 1) y USING (label, kind, path)),
b2 AS (SELECT * FROM b1 WHERE id NOT IN (SELECT before_id FROM s2)), a2 AS (SELECT * FROM a1 WHERE id NOT IN (SELECT after_id FROM s2)),
s3 AS (SELECT x.id AS before_id, y.id AS after_id, 'print' AS stage FROM (SELECT print, min(id) AS id FROM b2 GROUP BY 1 HAVING count(*) = 1) x
  JOIN (SELECT print, min(id) AS id FROM a2 GROUP BY 1 HAVING count(*) = 1) y USING (print)),
p AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3
  UNION ALL SELECT id, NULL, 'none' FROM b2 WHERE id NOT IN (SELECT before_id FROM s3) UNION ALL SELECT NULL, id, 'none' FROM a2 WHERE id NOT IN (SELECT after_id FROM s3))"""
_IMPACT = f"""WITH RECURSIVE {EDGES_SQL}, e AS (SELECT DISTINCT src, dst, kind FROM fk_edges WHERE kind <> 'contains'),
w(seed, id, k) AS (SELECT s, s, CAST(0 AS BIGINT) FROM (VALUES {', '.join(f"('{x}')" for x in SEEDS)}) t(s) UNION SELECT w.seed, e.src, w.k + 1 FROM w JOIN e ON e.dst = w.id WHERE w.k < 2),
m AS (SELECT seed, id, min(k) AS k FROM w GROUP BY 1, 2),
i AS (SELECT m.seed, m.id, m.k AS distance, min({{'kind': e.kind, 'dst': e.dst}}) AS x FROM m JOIN e ON e.src = m.id JOIN m p ON p.seed = m.seed AND p.id = e.dst AND p.k = m.k - 1 WHERE m.k > 0 GROUP BY 1, 2, 3)"""
_RULES = "ru(rule, severity, pattern) AS (VALUES " + ", ".join(f"('{r}', '{v}', '{p}')" for r, v, p in LINE_RULES if v != "low") + ")"


def _findings(text: str) -> str:
    return f"""(SELECT rule || ':' || doc_id || ':' || sha256(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS finding, rule, severity, doc_id AS id, line_no
  FROM (SELECT doc_id, unnest(string_split({text}, chr(10))) AS line, generate_subscripts(string_split({text}, chr(10)), 1) AS line_no FROM documents) JOIN ru ON regexp_matches(line, pattern) WHERE strlen(line) <= 400)"""


_EARLIER = "regexp_replace(regexp_replace(text, '%%%', '%', 'g'), '[.]\\n', '###' || chr(10), 'g')"
_DAILY = "m AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value) AS value FROM events GROUP BY 1, 2)"
_STEP = """CASE WHEN delta = 0 OR (percent IS NOT NULL AND abs(percent) <= 5) THEN 'flat' WHEN delta < 0 THEN 'improved' ELSE 'regressed' END"""
ORACLE_SQL = {
    "graph_diff_nodes": f"""WITH x AS ({_C.format(1997)}), y AS ({_C.format(1998)}), j AS (SELECT coalesce(x.id, y.id) AS id, CASE WHEN x.id IS NULL THEN 'added' WHEN y.id IS NULL THEN 'removed' WHEN x.orders_count <> y.orders_count THEN 'changed' END AS change
  FROM x FULL JOIN y ON x.id = y.id) SELECT * FROM j WHERE change IS NOT NULL""",
    "graph_diff_churn": _DIFF + """SELECT dst, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change IN ('added', 'removed')) AS total FROM j WHERE change IS NOT NULL GROUP BY dst""",
    "change_classification": _PAIRS + """ SELECT before_id, after_id, stage, CASE WHEN before_id IS NULL THEN 'added' WHEN after_id IS NULL THEN 'removed' WHEN b.label <> a.label OR b.kind <> a.kind THEN 'signature'
  WHEN b.path <> a.path THEN 'moved' WHEN b.print <> a.print THEN 'body' ELSE 'unchanged' END AS change FROM p LEFT JOIN b ON b.id = before_id LEFT JOIN a ON a.id = after_id""",
    "change_impact": _IMPACT + " SELECT seed, id, distance, x.kind AS relation, x.dst AS via FROM i",
    "select_affected": _IMPACT + """, r AS (SELECT id AS \"check\", distance, 'dependent:' || seed || ':' || distance AS reason FROM i WHERE regexp_matches(id, '^customer:.*7$')
  UNION ALL SELECT 'customer:7', 1, 'name:part:7:1' UNION ALL SELECT 'customer:17', 0, 'changed:customer:17:0')
SELECT \"check\", CAST(min(distance) AS BIGINT) AS distance, array_to_string(list_sort(list(DISTINCT reason)), ',') AS reasons FROM r GROUP BY 1 ORDER BY 2, 1 LIMIT 50""",
    "audit_line_rules": f"WITH {_RULES} SELECT finding, rule, severity, id, line_no FROM {_findings('text')}",
    "audit_debt_partition": f"""WITH {_RULES}, c AS (SELECT DISTINCT finding FROM {_findings('text')}), b AS (SELECT DISTINCT finding FROM {_findings(_EARLIER)})
SELECT CASE WHEN b.finding IS NULL THEN 'new' WHEN c.finding IS NULL THEN 'fixed' ELSE 'existing' END AS status, count(*) AS n FROM c FULL JOIN b ON c.finding = b.finding GROUP BY 1""",
    "hotspot_scores": """WITH c AS (SELECT l_partkey AS path, count(DISTINCT l_orderkey) AS changes, count(DISTINCT l_suppkey) AS degree FROM lineitem GROUP BY 1)
SELECT path, changes, degree, changes * (degree + 1) AS score FROM c ORDER BY score DESC, path LIMIT 20""",
    "perf_last_points": f"WITH {_DAILY} SELECT event_type, CAST(day AS VARCHAR) AS revision, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS r FROM m) WHERE r <= 7",
    "perf_by_symbol": f"""WITH {_DAILY}, l AS (SELECT *, lag(value) OVER w AS before, value - lag(value) OVER w AS delta FROM m WINDOW w AS (PARTITION BY event_type ORDER BY day)),
s AS (SELECT *, {_STEP} AS verdict FROM (SELECT *, CASE WHEN before <> 0 THEN delta / before * 100 END AS percent FROM l WHERE before IS NOT NULL)),
u AS (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day, user_id AS symbol FROM events), k AS (SELECT event_type, day, count(*) AS n FROM u GROUP BY 1, 2)
SELECT symbol, count(*) AS steps, round(CAST(sum(CAST(delta AS DECIMAL(28,10))) AS DOUBLE), 4) AS delta_sum, round(CAST(sum(CAST(delta / n AS DECIMAL(28,10))) AS DOUBLE), 4) AS weighted_delta, min(n) AS best_isolation,
  count(*) FILTER (verdict = 'improved') AS improved, count(*) FILTER (verdict = 'regressed') AS regressed, count(*) FILTER (verdict = 'flat') AS flat, CASE WHEN min(n) <= 1 THEN 'isolated' ELSE 'co_changed' END AS evidence
FROM s JOIN k USING (event_type, day) JOIN u USING (event_type, day) GROUP BY symbol""",
    "perf_noise_floor": """WITH l AS (SELECT event_type, CAST(ts AS DATE) AS day, value, lag(value) OVER w AS before, lag(CAST(ts AS DATE)) OVER w AS was FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id))
SELECT event_type, count(*) AS samples, round(max(coalesce(abs(CASE WHEN before <> 0 THEN (value - before) / before * 100 END), 0)), 6) AS max_abs_percent FROM l WHERE was = day GROUP BY event_type""",
}
