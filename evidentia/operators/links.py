"""Nearest vectors, links between them, and link suggestions under a policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cuts import cut
from .nearest import top_k


def links(rows: DataFrame, queries: DataFrame, k: int, min_similarity: float, selection: str) -> DataFrame:
    """(a, b, similarity): links of queries(id) to their nearest rows. directed: b is of a's k nearest; mutual: each is of the other's;
    union: either is, told from what a's search and its neighbours' searches saw.
    """
    if selection not in ("directed", "mutual", "union"):
        raise ValueError(f"no such selection: {selection}")
    ahead = cut(top_k(rows, queries, k).where(F.col("similarity") >= min_similarity).select(F.col("query_id").alias("a"), F.col("id").alias("b"), "similarity"))
    if selection == "directed":
        return ahead
    back = top_k(rows, ahead.select(F.col("b").alias("id")), k).where(F.col("similarity") >= min_similarity)
    back = back.select(F.col("id").alias("a"), F.col("query_id").alias("b"), F.col("similarity").alias("back"))
    if selection == "mutual":
        return ahead.join(back.select("a", "b"), ["a", "b"])
    asked = back.join(queries.select(F.col("id").alias("a")).distinct(), "a", "left_semi")
    return ahead.join(asked, ["a", "b"], "full_outer").select("a", "b", F.coalesce("similarity", "back").alias("similarity"))


def suggest_links(found: DataFrame, pages: DataFrame, existing: DataFrame, per_source: int) -> DataFrame:
    """(source, target, similarity, rank): links(a, b, similarity) a page may carry, the best per_source of each page.

    pages(id, site, canonical, language, source_ok, target_ok, priority). Both pages are eligible, of one site and language, not
    two faces of one canonical page, and not linked yet in existing(source, target). Order: similarity, target's priority, id.
    """
    side = lambda p: pages.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "site", "canonical", "language", "source_ok", "target_ok", "priority")])
    j = found.join(side("s"), F.col("a") == F.col("s_id")).join(side("t"), F.col("b") == F.col("t_id"))
    j = j.where("s_source_ok and t_target_ok and s_site = t_site and s_canonical <> t_canonical").where(F.col("s_language").eqNullSafe(F.col("t_language")))
    j = j.join(existing.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct(), ["a", "b"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), F.desc("t_priority"), "b"))
    return j.withColumn("rank", rank.cast("long")).where(F.col("rank") <= per_source).select(F.col("a").alias("source"), F.col("b").alias("target"), "similarity", "rank")
