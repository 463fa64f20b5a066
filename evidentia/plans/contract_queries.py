"""Contracts of events, routes, signatures and schemas, over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts
from ..sources.tables import table

BINDINGS = [("x0", "purchase.*.k1", "q_one"), ("x1", "view.#", "q_view"), ("x2", "click.u1.*", "q_click"), ("x0", "#", "q_all"), ("x1", "error.u2", "q_short")]
CONSUMERS = [("q_one", "worker:1"), ("q_view", "worker:2"), ("q_click", "worker:3"), ("q_all", "worker:1"), ("q_short", "worker:4"), ("q_other", "worker:5")]
ROUTES = [("/{lang}/{id}", "GET"), ("/fr/:id", "POST"), ("/en/special", "GET"), ("/de/{id}", "PUT")]


def _events(s, d):
    return table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k"))


def verdicts(s, d):
    role = F.when(F.col("event_type") == "purchase", "producer").when(F.col("event_type") == "view", "consumer").when(F.col("event_type") == "signup", "configuration")
    # Keys by user as well, so that some have one side only.
    return contracts.event_verdicts(_events(s, d).select(F.concat_ws("/", "user_id", "k").alias("resource"), role.alias("role")).where("role is not null"), "resource")


def mismatches(s, d):
    family = F.element_at(F.array(*map(F.lit, ("kafka", "amqp", "jms"))), (F.col("user_id") % 3 + 1).cast("int"))
    entity = F.element_at(F.array(*map(F.lit, ("topic", "queue", "destination"))), (F.col("event_id") % 3 + 1).cast("int"))
    role = F.when(F.col("event_type") == "purchase", "producer").when(F.col("event_type") == "view", "consumer")
    return contracts.kind_mismatches(_events(s, d).select(F.col("k").alias("resource"), role.alias("role"), family.alias("family"), entity.alias("entity")).where("role is not null"))


def routing(s, d):
    key = F.concat(F.col("event_type"), F.lit(".u"), F.col("user_id") % 4, F.lit(".k"), F.col("k").cast("long") % 5)
    producers = _events(s, d).select(F.concat(F.lit("x"), F.col("user_id") % 3).alias("exchange"), key.alias("routing_key"))
    return contracts.routed(producers, s.createDataFrame(BINDINGS, "exchange string, binding string, queue string"), s.createDataFrame(CONSUMERS, "queue string, consumer string"))


def typed(s, d):
    p, identity = table(s, d, "part"), F.concat_ws("/", "p_brand", "p_name")
    asked = F.when(F.col("p_partkey") % 17 == 0, F.concat(identity, F.lit("?"))).otherwise(identity)
    mode = F.when(F.col("p_partkey") % 5 == 0, "STREAM").otherwise(F.col("p_type"))
    clients = p.select(F.concat(F.lit("client:"), F.col("p_size") % 3).alias("client"), asked.alias("identity"), mode.alias("mode"))
    return contracts.typed_matches(p.select(identity.alias("identity"), F.col("p_type").alias("mode")), clients)


def http(s, d):
    calls = table(s, d, "pages").select(F.col("page_id").alias("call"), F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"), F.when(F.col("page_id") % 4 == 0, "POST").otherwise("GET").alias("method"))
    return contracts.http_matches(s.createDataFrame(ROUTES, "route string, method string"), calls)


def runtime(s, d):
    static = table(s, d, "part").where("p_size < 40").select(F.concat(F.lit("part:"), "p_partkey").alias("key"))
    seen = table(s, d, "lineitem").select(F.concat(F.lit("part:"), "l_partkey").alias("key"), F.col("l_shipdate").alias("at"))
    return contracts.merge_runtime(static, seen, "2001-09-01", 60)


def schemas(s, d):
    n = table(s, d, "nation")
    kind = F.concat(F.lit("type"), F.col("n_regionkey") % 2)
    before = n.where("n_nationkey % 9 <> 4").select(F.col("n_name").alias("member"), kind.alias("type"), (F.col("n_nationkey") % 2 == 0).alias("required"))
    after = n.where("n_nationkey % 7 <> 3").select(F.col("n_name").alias("member"), F.when(F.col("n_nationkey") % 5 == 1, F.lit("type9")).otherwise(kind).alias("type"), (F.col("n_nationkey") % 4 < 2).alias("required"))
    return contracts.schema_states(before, after)


QUERIES = {
    "event_contract_states": verdicts, "event_contract_mismatches": mismatches, "amqp_routing_match": routing, "typed_contract_mismatch": typed,
    "http_contract_matches": http, "runtime_evidence_freshness": runtime, "schema_compatibility": schemas,
}

_K = "json_extract_string(props, '$.k')"
_FITS = {b: "^" + ("[.]".join("[^.]*" if w == "*" else w for w in b.split("."))) + "$" for _, b, _ in BINDINGS} | {"view.#": "^view([.].*)?$", "#": "^.*$"}
_ROUTE = "r(route, method, prefix, pattern) AS (VALUES " + ", ".join(f"('{r}', '{m}', '{r.split('{')[0].split(':')[0]}', '^{p}/?$')" for (r, m), p in zip(ROUTES, ("/[^/]+/[^/]+", "/fr/[^/]+", "/en/special", "/de/[^/]+"))) + ")"
ORACLE_SQL = {
    "event_contract_states": f"""WITH g AS (SELECT user_id || '/' || {_K} AS resource, count(*) FILTER (event_type = 'purchase') AS producers, count(*) FILTER (event_type = 'view') AS consumers, count(*) FILTER (event_type = 'signup') AS declared
  FROM events WHERE event_type IN ('purchase', 'view', 'signup') GROUP BY 1)
SELECT *, CASE WHEN producers > 0 AND consumers > 0 THEN 'MATCH' WHEN producers = 0 AND consumers = 0 THEN 'CONFIGURATION_ONLY' ELSE 'UNPAIRED' END AS verdict FROM g""",
    "event_contract_mismatches": f"""WITH o AS (SELECT DISTINCT {_K} AS resource, event_type, ['kafka', 'amqp', 'jms'][user_id % 3 + 1] AS family, ['topic', 'queue', 'destination'][event_id % 3 + 1] AS entity FROM events),
j AS (SELECT CASE WHEN p.family <> c.family THEN 'TRANSPORT_MISMATCH' WHEN p.entity <> c.entity AND NOT (p.family = 'jms' AND (p.entity = 'destination' OR c.entity = 'destination')) THEN 'DESTINATION_KIND_MISMATCH' END AS code,
  p.resource, p.family || ':' || p.entity AS producer, c.family || ':' || c.entity AS consumer FROM o p JOIN o c ON p.resource = c.resource AND p.event_type = 'purchase' AND c.event_type = 'view') SELECT * FROM j WHERE code IS NOT NULL""",
    "amqp_routing_match": f"""WITH p AS (SELECT DISTINCT 'x' || (user_id % 3) AS exchange, event_type || '.u' || (user_id % 4) || '.k' || (CAST({_K} AS BIGINT) % 5) AS routing_key FROM events),
b(exchange, binding, queue, fits) AS (VALUES {', '.join(f"('{x}', '{b}', '{q}', '{_FITS[b]}')" for x, b, q in BINDINGS)}), c(queue, consumer) AS (VALUES {', '.join(f"('{q}', '{w}')" for q, w in CONSUMERS)})
SELECT exchange, routing_key, binding, queue, consumer, CASE WHEN regexp_matches(routing_key, fits) THEN 'COMPATIBLE' ELSE 'AMQP_ROUTING_KEY_MISMATCH' END AS routing FROM p JOIN b USING (exchange) JOIN c USING (queue)""",
    "typed_contract_mismatch": """WITH g AS (SELECT p_brand || '/' || p_name AS identity, list_sort(list(DISTINCT p_type)) AS modes FROM part GROUP BY 1),
c AS (SELECT DISTINCT 'client:' || (p_size % 3) AS client, CASE WHEN p_partkey % 17 = 0 THEN p_brand || '/' || p_name || '?' ELSE p_brand || '/' || p_name END AS identity, CASE WHEN p_partkey % 5 = 0 THEN 'STREAM' ELSE p_type END AS mode FROM part),
s AS (SELECT *, CASE WHEN modes IS NULL THEN 'MISSING_PROVIDER' WHEN list_contains(modes, mode) THEN 'matched' ELSE 'MODE_MISMATCH' END AS state FROM c LEFT JOIN g USING (identity))
SELECT client, identity, mode, state, CASE WHEN state = 'MODE_MISMATCH' THEN array_to_string(modes, ',') ELSE '' END AS expected FROM s""",
    "http_contract_matches": f"""WITH {_ROUTE}, c AS (SELECT page_id AS call, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, CASE WHEN page_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method FROM pages),
m AS (SELECT c.*, r.route, r.method = c.method AS same, row_number() OVER (PARTITION BY call ORDER BY r.method = c.method DESC, length(prefix) DESC, route DESC) AS k FROM c JOIN r ON regexp_matches(path, pattern))
SELECT c.call, c.path, c.method, m.route, CASE WHEN m.call IS NULL THEN 'MISSING_ENDPOINT' WHEN m.same THEN 'matched' ELSE 'METHOD_MISMATCH' END AS state FROM c LEFT JOIN m ON c.call = m.call AND m.k = 1""",
    "runtime_evidence_freshness": """WITH s AS (SELECT 'part:' || p_partkey AS key FROM part WHERE p_size < 40), r AS (SELECT 'part:' || l_partkey AS key, max(l_shipdate) AS seen FROM lineitem GROUP BY 1)
SELECT coalesce(s.key, r.key) AS key, CASE WHEN r.key IS NULL THEN 'static_only' WHEN s.key IS NULL THEN 'runtime_only' ELSE 'both' END AS evidence,
  CASE WHEN seen IS NULL THEN 'none' WHEN date_diff('day', CAST(seen AS DATE), DATE '2001-09-01') <= 60 THEN 'fresh' ELSE 'stale' END AS freshness FROM s FULL JOIN r ON s.key = r.key""",
    "schema_compatibility": """WITH b AS (SELECT n_name AS member, 'type' || (n_regionkey % 2) AS type, n_nationkey % 2 = 0 AS required FROM nation WHERE n_nationkey % 9 <> 4),
a AS (SELECT n_name AS member, CASE WHEN n_nationkey % 5 = 1 THEN 'type9' ELSE 'type' || (n_regionkey % 2) END AS type, n_nationkey % 4 < 2 AS required FROM nation WHERE n_nationkey % 7 <> 3)
SELECT coalesce(a.member, b.member) AS member, CASE WHEN b.member IS NULL THEN CASE WHEN a.required THEN 'added_required' ELSE 'added' END WHEN a.member IS NULL THEN 'removed' WHEN a.type <> b.type THEN 'retyped' WHEN a.required AND NOT b.required THEN 'now_required' ELSE 'kept' END AS state
FROM b FULL JOIN a ON a.member = b.member""",
}
