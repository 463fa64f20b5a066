"""Policy, change, search, similarity, contract, measurement and memory questions over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import nearest, source
from ..operators.joins import dealt
from ..sources.tables import table


def _lines(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "line")


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"


def lines_window(s, d):
    return _lines(s, d).where("doc_id = 7 and line_no between 2 and 6")


def cochange(s, d, least: int = 2):
    """Pairs of parts that share at least so many orders."""
    l = table(s, d, "lineitem").select("l_orderkey", "l_partkey")
    b = dealt(l, l.count(), "l_orderkey").distinct()
    # As many pairs as there are, so that no task counts more of them as the table grows.
    n = b.groupBy("l_orderkey").agg(F.count("*").alias("k")).agg(F.sum(F.expr("k * (k - 1) div 2"))).first()[0]
    pairs = b.alias("x").join(b.alias("y"), F.expr("x.l_orderkey = y.l_orderkey and x.l_partkey < y.l_partkey")).select(F.col("x.l_partkey").alias("part_a"), F.col("y.l_partkey").alias("part_b"))
    return dealt(pairs, n or 0, "part_a", "part_b").groupBy("part_a", "part_b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def perf_steps(s, d):
    """Mean value per day and event type against the day before: change in percent and verdict."""
    m = table(s, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg((F.sum(F.col("value").cast("decimal(18,4)")).cast("double") / F.count("value")).alias("mean"))
    w = Window.partitionBy("event_type").orderBy("day")
    p = m.withColumn("before", F.lag("mean").over(w)).where("before is not null and before <> 0").withColumn("percent", F.round((F.col("mean") - F.col("before")) * 100 / F.col("before"), 6))
    verdict = F.when(F.col("percent") > 20, "regressed").when(F.col("percent") < -20, "improved").otherwise("steady")
    return p.select("event_type", F.col("day").cast("string").alias("day"), "percent", verdict.alias("verdict"))


def memory_asof(s, d):
    """Latest event per user and type as of 2024-01-15, ties by event id."""
    e = table(s, d, "events").where("ts <= '2024-01-15'")
    return e.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("m")).select("user_id", "event_type", F.col("m.event_id").alias("event_id"), F.round("m.value", 6).alias("value"))


def context_budget(s, d, budget: int = 400):
    """The latest turns of each conversation whose texts fit a budget of characters."""
    c = table(s, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))
    return source.fit_budget(c, "conv_id", "turn", "chars", budget).select("conv_id", "turn", "role", "used")


def contract_verdicts(s, d):
    """Per key: producers (purchase) against consumers (view) of events."""
    e = table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    g = e.groupBy("k").agg(F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("producers"), F.sum(F.when(F.col("event_type") == "view", 1).otherwise(0)).alias("consumers"))
    verdict = F.when((F.col("producers") > 0) & (F.col("consumers") > 0), "matched").when(F.col("producers") > 0, "no_consumer").when(F.col("consumers") > 0, "no_producer").otherwise("unused")
    return g.withColumn("verdict", verdict)


def policy_forbid(s, d):
    """Orders of one region's customers filled by a forbidden region's suppliers: each (customer nation, supplier nation)."""
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    c = table(s, d, "customer").join(n.where("r_name = 'ASIA'"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("customer_nation"))
    p = table(s, d, "supplier").join(n.where("r_name = 'EUROPE'"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("supplier_nation"))
    l = table(s, d, "lineitem").select("l_orderkey", "l_suppkey").join(p, F.col("l_suppkey") == F.col("s_suppkey"))
    o = table(s, d, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("customer_nation", "supplier_nation").agg(F.count("*").alias("violations"))


def vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def every_hundredth(rows):
    """The queries of a search: rows whose id is divisible by 100."""
    return rows.where(F.col("id") % 100 == 0).select("id")


def vector_topk(s, d, k: int = 10):
    """Exact cosine top k, among all vectors, of every vector whose id is divisible by 100."""
    rows = vectors(s, d)
    return nearest.top_k(rows, every_hundredth(rows), k).withColumnRenamed("id", "vec_id")


def vector_topk_index(s, d, k: int = 10, recall: float = 0.98):
    """The same through an index of all vectors; as many lists are scanned as that recall takes."""
    index = nearest.build_index(vectors(s, d))
    asked = index.rows.where(F.col("id") % 100 == 0)
    return nearest.search(index, asked, k, nearest.probes_for(index, k, recall)).withColumnRenamed("id", "vec_id")


def _search(s, d, matches, **context):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return source.matching_lines(docs, matches, 3, **context).withColumnRenamed("id", "doc_id")


QUERIES = {
    "line_search_literal": lambda s, d: _search(s, d, lambda x: F.contains(x, F.lit("the"))).drop("context"),
    "line_search_regex": lambda s, d: _search(s, d, lambda x: x.rlike("[0-9]{4,}")).drop("context"),
    "line_search_context": lambda s, d: _search(s, d, lambda x: F.contains(x, F.lit("the")), before=1, after=1),
    "read_lines_window": lines_window,
    "exact_duplicates": lambda s, d: table(s, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1"),
    "commit_hotspots": lambda s, d: table(s, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(20),
    "cochange_pairs": cochange,
    "perf_steps": perf_steps,
    "memory_projection_asof": memory_asof,
    "token_budget_fit": context_budget,
    "event_contract_verdicts": contract_verdicts,
    "policy_forbid_direct": policy_forbid,
    # Parts in no line item at all.
    "dead_nodes": lambda s, d: table(s, d, "part").select("p_partkey", "p_name").join(table(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti"),
    "coverage_by_source": lambda s, d: table(s, d, "documents").select("doc_id", "source").join(table(s, d, "labels").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left").groupBy("source").agg(F.count("*").alias("found"), F.count("hit").alias("hit")),
    "vector_topk_exact": vector_topk, "vector_topk_index": vector_topk_index,
    "endpoint_listing": lambda s, d: table(s, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path")),
    "shared_across_repositories": lambda s, d: table(s, d, "lineitem").join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_partkey").agg(F.count_distinct("s_nationkey").alias("nations")).where("nations > 1"),
}
_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"


def _search_sql(cond: str, more: str = "") -> str:
    return f"""WITH {_LINES}, h AS (SELECT doc_id, line_no FROM l WHERE {cond}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k, count(*) OVER (PARTITION BY doc_id) AS total FROM h) SELECT doc_id, line_no, total{more} FROM r{" JOIN documents USING (doc_id)" if more else ""} WHERE k <= 3"""


ORACLE_SQL = {
    "line_search_literal": _search_sql("contains(line, 'the')"),
    "line_search_regex": _search_sql("regexp_matches(line, '[0-9]{4,}')"),
    "line_search_context": _search_sql("contains(line, 'the')", ", array_to_string(string_split(text, chr(10))[greatest(line_no - 1, 1):line_no + 1], chr(10)) AS context"),
    "read_lines_window": f"WITH {_LINES} SELECT doc_id, line_no, line FROM l WHERE doc_id = 7 AND line_no BETWEEN 2 AND 6",
    "exact_duplicates": "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "commit_hotspots": "SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20",
    "cochange_pairs": "WITH b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT x.l_partkey AS part_a, y.l_partkey AS part_b, count(*) AS n FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2 HAVING count(*) >= 2",
    "perf_steps": """WITH m AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value) AS mean FROM events GROUP BY 1, 2),
b AS (SELECT *, lag(mean) OVER (PARTITION BY event_type ORDER BY day) AS before FROM m), p AS (SELECT *, round((mean - before) * 100 / before, 6) AS percent FROM b WHERE before IS NOT NULL AND before <> 0)
SELECT event_type, CAST(day AS VARCHAR) AS day, percent, CASE WHEN percent > 20 THEN 'regressed' WHEN percent < -20 THEN 'improved' ELSE 'steady' END AS verdict FROM p""",
    "memory_projection_asof": """SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE ts <= TIMESTAMP '2024-01-15') WHERE k = 1""",
    "token_budget_fit": "SELECT conv_id, turn, role, used FROM (SELECT *, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations) WHERE used <= 400",
    "event_contract_verdicts": """WITH g AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS producers, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS consumers FROM events GROUP BY 1)
SELECT *, CASE WHEN producers > 0 AND consumers > 0 THEN 'matched' WHEN producers > 0 THEN 'no_consumer' WHEN consumers > 0 THEN 'no_producer' ELSE 'unused' END AS verdict FROM g""",
    "policy_forbid_direct": """SELECT nc.n_name AS customer_nation, ns.n_name AS supplier_nation, count(*) AS violations FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation nc ON c_nationkey = nc.n_nationkey
JOIN region rc ON nc.n_regionkey = rc.r_regionkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ns ON s_nationkey = ns.n_nationkey JOIN region rs ON ns.n_regionkey = rs.r_regionkey WHERE rc.r_name = 'ASIA' AND rs.r_name = 'EUROPE' GROUP BY 1, 2""",
    "dead_nodes": "SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)",
    "coverage_by_source": "SELECT source, count(*) AS found, count(labels.doc_id) AS hit FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
    "vector_topk_exact": f"""WITH e AS (SELECT vec_id, embedding, sqrt({_DOT.format(a='embedding', b='embedding')}) AS norm FROM embeddings),
c AS (SELECT q.vec_id AS query_id, e.vec_id, round({_DOT.format(a='e.embedding', b='q.embedding')} / (e.norm * q.norm), 6) AS similarity FROM e JOIN e q ON e.vec_id <> q.vec_id AND q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM c) SELECT query_id, rank, vec_id, similarity FROM r WHERE rank <= 10""",
    "endpoint_listing": "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages",
    "shared_across_repositories": "SELECT l_partkey, count(DISTINCT s_nationkey) AS nations FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 HAVING count(DISTINCT s_nationkey) > 1",
}
