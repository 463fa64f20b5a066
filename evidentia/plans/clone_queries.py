"""Near-miss clone families over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clones
from ..operators.cuts import cut_table
from ..sources.tables import table


def near_miss_clones(s, d):
    """family, id, start_line, end_line of each member, and the family's size; boilerplate would be left out by name, declarative text stays."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "lang", "source", "doc_id").alias("path"), "text")
    members, size = clones.families(cut_table(clones.clone_pairs(docs)))
    hidden = clones.suppress(members, docs)
    return members.join(size, "family").join(hidden, "family", "left_anti").select("family", F.col("id").cast("long").alias("doc_id"), "start_line", "end_line", "members", "size")


#: Chains of fingerprints and edit distances have no SQL; tests compare them with brute force.
QUERIES = {"near_miss_clones": near_miss_clones}
ORACLE_SQL: dict = {}
