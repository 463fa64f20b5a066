"""Searches over a kept index of all documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import textindex
from ..operators.cuts import shared_folder
from ..sources.tables import table

LITERAL, PATTERN, GLOBS = "and the", r"the [a-z]+ of", ["en/**", "de/*/*", "!en/src1/*"]


def _index(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "lang", "source", "doc_id").alias("path"), "text")
    return textindex.build(docs, f"{shared_folder(s)}/index-{uuid.uuid4().hex}")


def searches(s, d):
    """The first lines of a literal under globs and of a pattern, with the line before, and the totals."""
    index = _index(s, d)
    out = textindex.search(index, LITERAL, globs=GLOBS, most=200).withColumn("search", F.lit("literal"))
    out = out.unionByName(textindex.search(index, PATTERN, True, before=1, most=100).withColumn("search", F.lit("pattern")))
    return out.select("search", F.col("id").alias("doc_id"), "line_no", "context", "matching_lines", "files", "truncated")


QUERIES = {"indexed_search": searches}
_HITS = """{n} AS (SELECT *, count(*) OVER () AS matching_lines, dense_rank() OVER (ORDER BY path, doc_id) AS f, row_number() OVER (ORDER BY path, doc_id, line_no) AS k FROM l WHERE {where})"""
ORACLE_SQL = {
    "indexed_search": f"""WITH b AS (SELECT doc_id, lang || '/' || source || '/' || doc_id AS path, string_split(text, chr(10)) AS lines FROM documents),
l AS MATERIALIZED (SELECT doc_id, path, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no, lines FROM b),
{_HITS.format(n='a', where=f"contains(line, '{LITERAL}') AND (path LIKE 'en/%' OR path LIKE 'de/%') AND path NOT LIKE 'en/src1/%'")},
{_HITS.format(n='p', where=f"regexp_matches(line, '{PATTERN}')")}
SELECT 'literal' AS search, doc_id, line_no, line AS context, matching_lines, (SELECT max(f) FROM a) AS files, matching_lines > 200 AS truncated FROM a WHERE k <= 200
UNION ALL SELECT 'pattern', doc_id, line_no, array_to_string(lines[greatest(1, line_no - 1) : line_no], chr(10)), matching_lines, (SELECT max(f) FROM p), matching_lines > 100 FROM p WHERE k <= 100""",
}
