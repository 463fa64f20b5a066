"""Questions about paths, spans, lines, links and budgets, and the streamed answers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import links, source
from ..operators.cuts import cut, shared_folder
from ..sources.tables import table
from ..streaming import memory, projections
from .graphs import EDGES_SQL, fk_edges
from .table_queries import _DOT, every_hundredth, vectors

#: A path for each part, by its key's rest: directory, ending.
PLACES = [("src/{t}/", ".ts"), ("tests/", "_test.py"), ("docs/", ".md"), ("src/", ".test.js"), ("pkg/vendor/", ".go"), ("", ".config.mjs"), ("app/{t}/", ".rs"), (".github/workflows/", ".yml")]
QUOTAS = {"caller": 2, "callee": 3, "other": 10}


def part_paths(s, d):
    p = table(s, d, "part")
    name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.col("p_partkey").cast("string"))
    out = F.when(F.lit(False), F.lit(""))
    for k, (where, ending) in enumerate(PLACES):
        head, _, tail = where.partition("{t}")
        lead = F.concat(F.lit(head), F.lower("p_type"), F.lit(tail)) if "{t}" in where else F.lit(where)
        out = out.when(F.col("p_partkey") % len(PLACES) == k, F.concat(lead, name, F.lit(ending)))
    return p.select("p_partkey", out.alias("path"))


def classes(s, d):
    p = part_paths(s, d)
    path = F.col("path")
    return p.select("path", paths.path_class(path).alias("class"), paths.is_test_suite(path).alias("suite"), paths.covered_stem(path).alias("covers"), paths.in_scope(path, "./src/").alias("in_src"), paths.matches_globs(path, ["src/**", "app/*/*", "!src/**/*.test.js"]).alias("in_workspace"))


def redactions(s, d):
    docs = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).where(F.contains("line", F.lit('"')))
    kv = docs.select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), F.regexp_extract("line", r'([A-Za-z_]+) *[=:] *"[^"]*"', 1).alias("key"), F.regexp_extract("line", r'[A-Za-z_]+ *[=:] *"([^"]*)"', 1).alias("value"))
    return kv.where("key <> ''").select("doc_id", "line_no", "key", text.redacted(F.col("key"), F.col("value")).alias("shown"))


def positions(s, d):
    """A customer is a file, its orders are spans of days, and one day of it is asked for."""
    day = lambda c: F.datediff(c, F.lit("1995-01-01").cast("date"))
    o = table(s, d, "orders")
    spans = o.select(F.col("o_custkey").alias("file"), F.concat(F.lit("order:"), "o_orderkey").alias("name"), day("o_orderdate").cast("long").alias("start"), (day("o_orderdate") + F.col("o_orderkey") % 400).cast("long").alias("end"))
    points = table(s, d, "customer").select(F.col("c_custkey").alias("file"), (F.lit(800) + F.col("c_custkey") % 500).cast("long").alias("at"))
    return source.at_position(spans, points)


def frames(s, d):
    pages = table(s, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"))
    files = pages.select(F.concat("host", "path").alias("path"))
    frame = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("C:\\build\\"), "host", "path")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/srv"), "path")).otherwise(F.concat(F.lit("/none/"), "page_id"))
    return source.match_frames(files, pages.select(frame.alias("frame")))


def quotas(s, d):
    e = fk_edges(s, d)
    near = e.where("src like 'supplier:%'").select(F.col("src").alias("subject"), F.col("dst").alias("other"), F.lit("callee").alias("bucket"))
    near = near.unionByName(e.where("dst like 'supplier:%'").select(F.col("dst").alias("subject"), F.col("src").alias("other"), F.when(F.col("kind") == "contains", "other").otherwise("caller").alias("bucket")))
    return source.by_quota(near, "subject", "bucket", ["other"], QUOTAS, 6).select("subject", "bucket", "other", "rank")


def token_budget(s, d, budget: int = 120):
    c = table(s, d, "conversations").select("conv_id", "turn", text.token_estimate(F.col("text")).alias("tokens"))
    return source.fit_budget(c, "conv_id", "turn", "tokens", budget).select("conv_id", "turn", "used")


def endpoint_page(s, d):
    p = table(s, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"))
    return source.with_page(p, ["path", "page_id"], 20, 15)


def vector_links(selection: str):
    def run(s, d):
        rows = cut(vectors(s, d))
        return links.links(rows, every_hundredth(rows), 10, 0.1, selection)

    return run


def suggestions(s, d):
    """Pages take the vectors of their number; a page of another path may be linked if it is not the next one, which it links."""
    rows = cut(vectors(s, d))
    url = F.col("url")
    host = F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)
    pages = table(s, d, "pages").select(
        F.col("page_id").alias("id"), F.regexp_extract(host, r"([^.]+[.][^.]+)$", 1).alias("site"), F.regexp_extract(url, r"^([^?#]*)", 1).alias("canonical"), F.regexp_extract(url, r"^[a-z]+://[^/?#]+/([^/?#]*)", 1).alias("language"),
        F.lit(True).alias("source_ok"), (F.col("page_id") % 7 != 0).alias("target_ok"), (F.col("page_id") % 3).alias("priority"),
    )
    existing = pages.select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    return links.suggest_links(links.links(rows, every_hundredth(rows), 50, -1.0, "directed"), pages, existing, 3)


def memory_stream(s, d):
    e = projections.event_stream(s, f"{d}/events*.parquet").where("ts <= '2024-01-15'")
    out = projections.run_available(s, projections.latest_by_key(e, ["user_id", "event_type"], "ts", "event_id", ["value"]), "complete")
    return out.select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


def bitemporal(s, d):
    """What was known on 20 January of each user and event type, as of the 15th, from facts taken over a stream; an event is recorded up to six hours late."""
    e = projections.event_stream(s, f"{d}/events*.parquet")
    recorded = F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 7).cast("int"))
    facts = e.select(F.concat_ws(":", "user_id", "event_type").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("valid"), recorded.cast("timestamp").alias("recorded"), F.round("value", 6).cast("string").alias("value"))
    # Files of the table come in any order, so none of it is late.
    kept = memory.keep(s, facts, f"{shared_folder(s)}/memory-{uuid.uuid4().hex}", 10_000 * 86_400_000)
    return memory.as_of(kept, "2024-01-15 00:00:00", "2024-01-20 00:00:00").select("key", "event_id", F.col("value").cast("double").alias("value"))


QUERIES = {
    "path_classes": classes, "secret_redaction": redactions, "definition_at_position": positions, "stack_frame_suffix_match": frames, "context_bundle_quota": quotas,
    "token_budget_tokens": token_budget, "endpoint_page": endpoint_page, "vector_mutual_links": vector_links("mutual"), "vector_union_links": vector_links("union"),
    "link_suggestions": suggestions, "memory_projection_stream": memory_stream, "memory_bitemporal": bitemporal,
    "string_block_duplicates": lambda s, d: source.block_duplicates(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")),
}

_PATHS = "CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN '{w.replace('{t}', chr(39) + ' || lower(p_type) || ' + chr(39))}' || n || '{e}'" for k, (w, e) in enumerate(PLACES)) + " END"
_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(lower(path), '{'|'.join(p)}') THEN '{c}'" for c, p in paths.PATTERNS) + " ELSE 'product' END"
_STEM = "regexp_replace(regexp_replace(lower(path), '^.*/', ''), '(.)[.][^.]*$', '\\1')"
_SECRET = "|".join(text.SECRET_KEYS)
_LINE = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"
_SIM = f"""e AS (SELECT vec_id AS id, embedding AS v, sqrt({_DOT.format(a='embedding', b='embedding')}) AS norm FROM embeddings),
s AS (SELECT x.id AS a, y.id AS b, round({_DOT.format(a='x.v', b='y.v')} / (x.norm * y.norm), 6) AS similarity FROM e x JOIN e y ON x.id <> y.id),
t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS r FROM s), k AS (SELECT a, b, similarity FROM t WHERE r <= 10 AND similarity >= 0.1)"""
_SEGMENTS = "list_filter(string_split(replace({}, chr(92), '/'), '/'), lambda x: x <> '' AND x <> '.' AND NOT ends_with(x, ':'))"
ORACLE_SQL = {
    "path_classes": f"""WITH f AS (SELECT {_PATHS} AS path FROM (SELECT *, replace(p_name, ' ', '_') || p_partkey AS n FROM part)), g AS (SELECT path, {_CLASS} AS class, regexp_matches(lower(path), '{'|'.join(paths.SUITES)}') AS suite, {_STEM} AS stem FROM f)
SELECT path, class, suite, nullif(CASE WHEN regexp_matches(stem, '[.](test|spec)') THEN regexp_extract(stem, '^(.*?)[.](?:test|spec)', 1) WHEN starts_with(stem, 'test_') THEN substr(stem, 6) WHEN ends_with(stem, '_test') THEN regexp_replace(stem, '_test$', '')
  WHEN contains(lower(path), '/__tests__/') THEN stem END, '') AS covers, path = 'src' OR starts_with(path, 'src/') AS in_src,
  CASE WHEN regexp_matches(path, '^src/(.*/)?[^/]*[.]test[.]js$') THEN false ELSE regexp_matches(path, '^app/[^/]*/[^/]*$') OR starts_with(path, 'src/') END AS in_workspace FROM g""",
    "secret_redaction": f"""WITH k AS (SELECT doc_id, line_no, regexp_extract(line, '([A-Za-z_]+) *[=:] *"[^"]*"', 1) AS key, regexp_extract(line, '[A-Za-z_]+ *[=:] *"([^"]*)"', 1) AS value FROM {_LINE})
SELECT doc_id, line_no, key, CASE WHEN regexp_matches(lower(key), '{_SECRET}') OR (contains(value, '://') AND contains(value, '@')) THEN '[redacted]' ELSE value END AS shown FROM k WHERE key <> ''""",
    "definition_at_position": """WITH s AS (SELECT o_custkey AS file, 'order:' || o_orderkey AS name, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS start, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 400 AS "end" FROM orders),
p AS (SELECT c_custkey AS file, CAST(800 + c_custkey % 500 AS BIGINT) AS "at" FROM customer),
j AS (SELECT file, "at", name, start, "end", row_number() OVER (PARTITION BY file, "at" ORDER BY "end" - start, name) AS r FROM s JOIN p USING (file) WHERE (start <= "at" AND "at" < "end") OR (start = "end" AND "at" = start))
SELECT file, "at", name, start, "end" FROM j WHERE r = 1""",
    "stack_frame_suffix_match": f"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages), f AS (SELECT DISTINCT host || path AS path FROM p),
r AS (SELECT DISTINCT CASE page_id % 3 WHEN 0 THEN 'C:' || chr(92) || 'build' || chr(92) || host || path WHEN 1 THEN '/srv' || path ELSE '/none/' || page_id END AS frame FROM p),
x AS (SELECT path, seg, unnest(range(1, len(seg) + 1)) AS k FROM (SELECT path, {_SEGMENTS.format('path')} AS seg FROM f)), y AS (SELECT frame, seg, unnest(range(1, len(seg) + 1)) AS k FROM (SELECT frame, {_SEGMENTS.format('frame')} AS seg FROM r)),
g AS (SELECT array_to_string(seg[len(seg) - k + 1:], '/') AS suffix, count(*) AS n, min(path) AS file FROM x GROUP BY 1),
b AS (SELECT frame, k, n, file, row_number() OVER (PARTITION BY frame ORDER BY k DESC) AS o FROM y JOIN g ON suffix = array_to_string(seg[len(seg) - k + 1:], '/'))
SELECT r.frame, CASE WHEN b.k IS NULL THEN 'none' WHEN n = 1 THEN 'one' ELSE 'many' END AS matched, CAST(coalesce(b.k, 0) AS BIGINT) AS overlap, file FROM r LEFT JOIN b ON b.frame = r.frame AND o = 1""",
    "context_bundle_quota": f"""WITH {EDGES_SQL}, n AS (SELECT src AS subject, dst AS other, 'callee' AS bucket FROM fk_edges WHERE src LIKE 'supplier:%' UNION ALL SELECT dst, src, CASE WHEN kind = 'contains' THEN 'other' ELSE 'caller' END FROM fk_edges WHERE dst LIKE 'supplier:%'),
q AS (SELECT *, row_number() OVER (PARTITION BY subject, bucket ORDER BY other) AS k, CASE bucket WHEN 'caller' THEN 1 WHEN 'callee' THEN 2 ELSE 3 END AS o FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY o, k) AS rank FROM q WHERE k <= CASE bucket WHEN 'caller' THEN 2 WHEN 'callee' THEN 3 ELSE 10 END) SELECT subject, bucket, other, rank FROM r WHERE rank <= 6""",
    "token_budget_tokens": "SELECT conv_id, turn, used FROM (SELECT *, CAST(sum(CAST(ceil(strlen(text) / 4.0) AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations) WHERE used <= 120",
    "endpoint_page": """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages), n AS (SELECT count(*) AS total FROM pages)
SELECT page_id, path, total, 35 < total AS has_more, CASE WHEN 35 < total THEN CAST(35 AS BIGINT) END AS next_offset FROM p, n ORDER BY path, page_id LIMIT 15 OFFSET 20""",
    "vector_mutual_links": f"WITH {_SIM} SELECT k.a, k.b, k.similarity FROM k JOIN k r ON r.a = k.b AND r.b = k.a WHERE k.a % 100 = 0",
    "link_suggestions": f"""WITH {_SIM.split('k AS (')[0]} l AS (SELECT a, b, similarity FROM t WHERE r <= 50 AND a % 100 = 0),
p AS (SELECT page_id AS id, regexp_extract(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '([^.]+[.][^.]+)$', 1) AS site, regexp_extract(url, '^([^?#]*)', 1) AS canonical, regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]*)', 1) AS language FROM pages),
j AS (SELECT a AS source, b AS target, similarity, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, y.id % 3 DESC, b) AS rank FROM l JOIN p x ON a = x.id JOIN p y ON b = y.id
  WHERE y.id % 7 <> 0 AND x.site = y.site AND x.canonical <> y.canonical AND x.language = y.language AND b <> a + 1) SELECT * FROM j WHERE rank <= 3""",
    "memory_bitemporal": """SELECT user_id || ':' || event_type AS key, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, recorded DESC, event_id DESC) AS r FROM
  (SELECT *, ts + to_hours(event_id % 7) AS recorded FROM events) WHERE ts <= TIMESTAMP '2024-01-15' AND recorded <= TIMESTAMP '2024-01-20') WHERE r = 1""",
    "memory_projection_stream": "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE ts <= TIMESTAMP '2024-01-15') WHERE k = 1",
    "string_block_duplicates": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), b AS (SELECT doc_id, k * 24 + 1 AS line, lines[k * 24 + 1:k * 24 + 24] AS block FROM (SELECT doc_id, lines, unnest(range(0, (len(lines) - 1) // 24 + 1)) AS k FROM l)),
g AS (SELECT sha256(array_to_string(block, chr(10))) AS digest, count(*) AS n, min({'id': doc_id, 'line': line}) AS f FROM b WHERE len(block) >= 3 GROUP BY 1) SELECT digest, n, f.id AS first_id, f.line AS first_line FROM g WHERE n > 1""",
}
