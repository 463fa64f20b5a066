"""Architecture policy over the foreign-key graph, budgets, and capabilities of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import policy
from ..operators.cuts import cut, cut_table
from ..sources.tables import table
from .graphs import EDGES_SQL, NODES_SQL, fk_edges, fk_nodes

COMPONENTS = [("africa", "AFRICA"), ("america", "AMERICA"), ("asia", "ASIA"), ("asia_two", "ASIA/NATION_2"), ("orders", "orders"), ("first_brand", "Brand#1")]
RULES = [
    ("orders_not_asia_two", "forbid", "direct", ["orders"], ["asia_two"], ["any"], "error"),
    ("america_only_orders", "allow_only", "direct", ["america"], ["orders"], ["runtime"], "warn"),
    ("africa_places_nothing", "forbid", "direct", ["africa"], ["orders"], ["places"], "error"),
    ("africa_needs_orders", "require", "direct", ["africa"], ["orders"], ["any"], "error"),
    ("asia_not_first_brand", "forbid", "transitive", ["asia"], ["first_brand"], ["any"], "error"),
]
BUDGETS = {"lines": 40, "longest_line": 2000}


def _contract(s):
    rules = s.createDataFrame(RULES, "rule string, action string, reachability string, sources array<string>, targets array<string>, kinds array<string>, severity string")
    return s.createDataFrame(COMPONENTS, "component string, prefix string"), rules


def component_paths(s, d):
    return policy.assign_components(fk_nodes(s, d), _contract(s)[0])


def direct(s, d):
    components, rules = _contract(s)
    assigned = cut(policy.assign_components(fk_nodes(s, d), components))
    return policy.direct_violations(policy.joined_edges(fk_edges(s, d), assigned), rules)


def by_path(s, d):
    components, rules = _contract(s)
    assigned = cut_table(policy.assign_components(fk_nodes(s, d), components))
    return policy.path_violations(fk_edges(s, d), assigned, rules)


def ratchet(s, d):
    """Per rule and status; the baseline knows some violations and two that are gone, a few are excepted."""
    found = cut(direct(s, d))
    stale = s.createDataFrame([("stale-1",), ("stale-2",)], "fingerprint string")
    baseline = found.where(F.substring("fingerprint", 1, 1) < "4").select("fingerprint").union(stale)
    exceptions = found.where(F.substring("fingerprint", 1, 1) == "f").select("fingerprint")
    return policy.ratchet(found, baseline, exceptions).groupBy("rule", "status").agg(F.count("*").alias("n"))


def budgets(s, d):
    lines = F.split("text", "\n")
    longest = F.array_max(F.transform(lines, F.length))
    docs = table(s, d, "documents").select(F.concat(F.lit("document:"), F.col("doc_id")).alias("subject"), F.explode(F.array(F.struct(F.lit("lines").alias("metric"), F.size(lines).cast("long").alias("actual")), F.struct(F.lit("longest_line").alias("metric"), longest.cast("long").alias("actual")))).alias("m"))
    return policy.over_budget(docs.select("m.metric", "subject", "m.actual"), BUDGETS)


def capabilities(s, d):
    """Hosts and the language they serve, against a declaration in which some hosts are gone, foreign or unknown."""
    pages = table(s, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/?#]+/([^/?#]*)", 1).alias("lang"))
    observed = pages.select(F.col("host").alias("endpoint"), F.col("lang").alias("owner"))
    h = pages.groupBy("host").agg(F.min("lang").alias("lang"))
    declared = h.where(~F.col("host").startswith("a")).select(
        F.concat(F.lit("serve:"), "host").alias("capability"), F.when(F.col("host").startswith("e"), F.concat(F.lit("gone."), "host")).otherwise(F.col("host")).alias("endpoint"),
        F.when(F.col("host").startswith("t"), F.lit("xx")).otherwise(F.col("lang")).alias("owner"),
    )
    return policy.capability_states(declared, observed)


QUERIES = {
    "component_by_longest_prefix": component_paths, "policy_direct": direct, "policy_paths": by_path, "policy_ratchet_partition": ratchet,
    "budget_violations": budgets, "capability_mapping": capabilities,
}

_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_COMPONENTS = "c(component, prefix) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in COMPONENTS) + ")"
_RULES = "ru(rule, action, reachability, sources, targets, kinds, severity) AS (VALUES " + ", ".join(f"('{r}', '{a}', '{h}', {_LIST(x)}, {_LIST(y)}, {_LIST(k)}, '{v}')" for r, a, h, x, y, k, v in RULES) + ")"
_ASSIGNED = f"""WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}, {_COMPONENTS}, {_RULES},
a AS (SELECT n.id, n.path, arg_max(c.component, length(c.prefix)) AS component FROM fk_nodes n LEFT JOIN c ON n.path = c.prefix OR starts_with(n.path, c.prefix || '/') GROUP BY n.id, n.path)"""
_DIRECT = f"""{_ASSIGNED}, j AS (SELECT e.src, e.dst, e.kind, x.component AS from_component, y.component AS to_component FROM fk_edges e JOIN a x ON e.src = x.id JOIN a y ON e.dst = y.id
  WHERE x.component IS NOT NULL AND x.component IS DISTINCT FROM y.component),
v AS (SELECT DISTINCT sha256(concat_ws('|', rule, src, dst, kind)) AS fingerprint, rule, severity, src, dst, kind, from_component, to_component FROM j JOIN ru ON list_contains(sources, from_component)
  WHERE reachability = 'direct' AND (list_contains(kinds, 'any') OR list_contains(kinds, 'runtime') OR list_contains(kinds, kind))
  AND ((action = 'forbid' AND list_contains(targets, to_component)) OR (action = 'allow_only' AND (to_component IS NULL OR NOT list_contains(targets, to_component)))))"""
ORACLE_SQL = {
    "component_by_longest_prefix": f"{_ASSIGNED} SELECT id, path, component FROM a",
    "policy_direct": f"{_DIRECT} SELECT * FROM v",
    "policy_paths": f"""{_ASSIGNED}, reach(id, hops) AS (SELECT id, CAST(0 AS BIGINT) FROM a WHERE component = 'first_brand' UNION SELECT e.src, r.hops + 1 FROM reach r JOIN fk_edges e ON e.dst = r.id),
near AS (SELECT id, min(hops) AS hops FROM reach WHERE hops > 0 GROUP BY id),
need AS (SELECT DISTINCT e.src AS id FROM fk_edges e JOIN a ON e.dst = a.id WHERE a.component = 'orders'),
f AS (SELECT 'asia_not_first_brand' AS rule, 'forbid' AS action, path AS source_path, min(hops) AS hops FROM a JOIN near USING (id) WHERE component = 'asia' GROUP BY path
  UNION ALL SELECT 'africa_needs_orders', 'require', path, NULL FROM a LEFT JOIN need ON a.id = need.id WHERE component = 'africa' GROUP BY path HAVING count(need.id) = 0)
SELECT sha256(concat_ws('|', rule, action, source_path)) AS fingerprint, rule, 'error' AS severity, source_path, hops FROM f""",
    "policy_ratchet_partition": f"""{_DIRECT}, b AS (SELECT fingerprint FROM v WHERE substr(fingerprint, 1, 1) < '4' UNION ALL SELECT 'stale-1' UNION ALL SELECT 'stale-2'),
s AS (SELECT v.rule, CASE WHEN v.fingerprint IS NULL THEN 'fixed' WHEN substr(v.fingerprint, 1, 1) = 'f' THEN 'excepted' WHEN b.fingerprint IS NOT NULL THEN 'existing' WHEN severity = 'warn' THEN 'warning' ELSE 'new' END AS status
  FROM v FULL JOIN b ON v.fingerprint = b.fingerprint) SELECT rule, status, count(*) AS n FROM s GROUP BY 1, 2""",
    "budget_violations": """WITH m AS (SELECT 'lines' AS metric, 'document:' || doc_id AS subject, CAST(len(string_split(text, chr(10))) AS BIGINT) AS actual, CAST(40 AS BIGINT) AS allowed FROM documents
UNION ALL SELECT 'longest_line', 'document:' || doc_id, CAST(list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS BIGINT), CAST(2000 AS BIGINT) FROM documents) SELECT * FROM m WHERE actual > allowed""",
    "capability_mapping": """WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]*)', 1) AS lang FROM pages),
o AS (SELECT host AS endpoint, list(DISTINCT lang) AS owners FROM p GROUP BY host), h AS (SELECT host, min(lang) AS lang FROM p GROUP BY host),
d AS (SELECT 'serve:' || host AS capability, CASE WHEN starts_with(host, 'e') THEN 'gone.' || host ELSE host END AS endpoint, CASE WHEN starts_with(host, 't') THEN 'xx' ELSE lang END AS owner FROM h WHERE NOT starts_with(host, 'a'))
SELECT capability, coalesce(d.endpoint, o.endpoint) AS endpoint, CASE WHEN capability IS NULL THEN 'unmapped' WHEN owners IS NULL THEN 'orphaned' WHEN list_contains(owners, owner) THEN 'served' ELSE 'drifted' END AS state
FROM d FULL JOIN o ON d.endpoint = o.endpoint""",
}
