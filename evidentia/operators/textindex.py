"""Search over a kept index of trigrams: the rarest postings are intersected, and what is left is verified line by line."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import matches_globs
from .cuts import cut, cut_table
from .joins import HOT
from .source import matching_lines

#: Postings of so many of a query's grams are intersected, the rarest.
RAREST = 4
#: Documents in one folder of texts, about, and the most folders there are.
SHARD, SHARDS = 2_000, 4_096
#: Documents whose grams leave a task together.
LOT = 256


@dataclass
class TextIndex:
    """postings(gram, id), sorted by both over many files; grams(gram, n); texts(id, path, text, shard), a folder for each shard."""

    postings: DataFrame
    grams: DataFrame
    texts: DataFrame
    shards: int


def grams_of(text: str) -> np.ndarray:
    """The distinct trigrams of a text's bytes in UTF-8, as numbers."""
    b = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.int32)
    return np.unique(b[:-2] << 16 | b[1:-1] << 8 | b[2:]) if len(b) > 2 else np.zeros(0, np.int32)


def _grams(batches):
    for pdf in batches:
        for k in range(0, len(pdf), LOT):
            own, g = pdf["id"].to_numpy()[k : k + LOT], [grams_of(t) for t in pdf["text"].tolist()[k : k + LOT]]
            yield pd.DataFrame({"gram": np.concatenate(g), "id": np.repeat(own, [len(x) for x in g])})


def build(docs: DataFrame, folder: str) -> TextIndex:
    """Write the index of docs(id, path, text) into folder. Null texts are empty; ids are unique longs.

    Postings are ordered by gram and id over all files, so those of one gram, however common, lie in few neighbouring row groups and no task
    holds them all.
    """
    d = docs.select(F.col("id").cast("long").alias("id"), "path", F.coalesce("text", F.lit("")).alias("text"))
    shards = max(1, min(SHARDS, d.count() // SHARD))
    d.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).repartition("shard").write.partitionBy("shard").parquet(f"{folder}/texts")
    # Written as found, since dealing by range goes through its rows twice.
    found = cut_table(d.select("id", "text").mapInPandas(_grams, "gram int, id long"))
    found.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.parquet(f"{folder}/postings")
    spark = docs.sparkSession
    spark.read.parquet(f"{folder}/postings").groupBy("gram").agg(F.count("*").alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{folder}/grams")
    return load(spark, folder, shards)


def load(spark: SparkSession, folder: str, shards: int) -> TextIndex:
    texts = spark.read.schema("id long, path string, text string, shard int").parquet(f"{folder}/texts")
    return TextIndex(spark.read.schema("gram int, id long").parquet(f"{folder}/postings"), spark.read.schema("gram int, n long").parquet(f"{folder}/grams"), texts, shards)


def required(query: str, is_regex: bool) -> list[str]:
    """Texts that every line that fits holds; none if that cannot be told."""
    if not is_regex:
        return [query]
    try:
        tree = re._parser.parse(query)
    except (re.error, OverflowError):
        return []
    if tree.state.flags & re.IGNORECASE:
        return []
    runs, run = [], ""
    for op, value in tree:
        if str(op) == "LITERAL":
            run += chr(value)
        else:
            runs.append(run)
            run = ""
            if str(op) == "SUBPATTERN" and not value[1] and not value[2] and all(str(o) == "LITERAL" for o, _ in value[3]):
                runs.append("".join(chr(v) for _, v in value[3]))
    return [r for r in [*runs, run] if r]


def candidates(index: TextIndex, query: str, is_regex: bool = False) -> DataFrame | None:
    """(id) of the documents that hold the query's RAREST grams; null if the query has no gram, so that all are candidates."""
    wanted = sorted({int(g) for r in required(query, is_regex) for g in grams_of(r)})
    if not wanted:
        return None
    known = {r["gram"]: r["n"] for r in index.grams.where(F.col("gram").isin(wanted)).collect()}  # no more than the query has
    rare = sorted(wanted, key=lambda g: (known.get(g, 0), g))[:RAREST]
    hits = index.postings.where(F.col("gram").isin(rare))
    return hits.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select("id")


def search(index: TextIndex, query: str, is_regex: bool = False, globs: list[str] | None = None, before: int = 0, after: int = 0, most: int = 40, budget: int | None = None) -> DataFrame:
    """(id, path, line_no, context, matching_lines, files, truncated): the first most matching lines in order of path, id and line, with totals of all.

    The same rows as a scan of all texts. globs choose paths, the last that fits decides. With a budget, contexts are clipped to twice as many
    characters (64 to 256), and lines go from the end until four bytes a token fit. Patterns are Spark's; a query without a gram scans.
    """
    texts, found = index.texts, candidates(index, query, is_regex)
    if found is not None:
        found = cut(found.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(index.shards)).cast("int")))
        shards = [r["shard"] for r in found.select("shard").distinct().collect()]  # SHARDS at most
        few = F.broadcast(found) if found.count() <= HOT else found
        texts = texts.where(F.col("shard").isin(shards)).join(few, ["shard", "id"], "left_semi")
    if globs:
        texts = texts.where(matches_globs(F.col("path"), globs))
    fits = (lambda x: F.rlike(x, F.lit(query))) if is_regex else (lambda x: F.contains(x, F.lit(query)))
    place = F.struct("path", "id")
    hits = cut(matching_lines(texts.select(place.alias("id"), "text"), fits, most, before, after))
    totals = hits.select("id", "total").distinct().agg(F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("matching_lines"), F.count("*").alias("files")).first()
    page = hits.orderBy("id", "line_no").limit(most).select("id.id", "id.path", "line_no", "context")
    if budget is not None:
        page = page.withColumn("context", F.substring("context", 1, min(256, max(64, 2 * budget))))
        # most rows at the most are put in order here.
        so_far = F.sum(F.octet_length("context")).over(Window.orderBy("path", "id", "line_no").rowsBetween(Window.unboundedPreceding, 0))
        page = page.withColumn("used", so_far).where(F.ceil(F.col("used") / 4) <= budget).drop("used")
    page = cut(page)
    return page.withColumns({"matching_lines": F.lit(totals["matching_lines"]), "files": F.lit(totals["files"]), "truncated": F.lit(page.count() < totals["matching_lines"])})
