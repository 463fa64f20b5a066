"""From documents to packed training bins: quality, line dedup, near-dedup, personal data, packing.

All stages but the last return the columns of documents alone; others, whatever their names, are left out. Texts of any length are
read whole, no rows give no rows, and rows with null or repeated ids are documents of their own, but where a stage says otherwise.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import lines, minhash, packing, pii, quality
from evidentia.llm.common import keyed, table
from evidentia.operators.cuts import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _distinct(docs: DataFrame, key: str) -> DataFrame:
    """docs without rows that repeat an earlier row's doc_id and text; null ids name no document, so they are never repeats."""
    again = docs.where(F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col(key))).select("doc_id").distinct()
    if again.isEmpty():
        return docs
    digest = F.coalesce(F.sha2("text", 256), F.lit(""))
    first = docs.join(again, "doc_id", "left_semi").groupBy("doc_id", digest.alias("d")).agg(F.min_by(key, F.struct(F.col(key) != F.col("doc_id"), F.col(key))).alias(key))
    plain = docs.join(again, "doc_id", "left_anti")
    return plain.unionByName(docs.join(first.select(key), key, "left_semi").select(*plain.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (predicted 0) go; null and empty texts are judged as all others."""
    return _documents(quality.score_quality(docs, table(spark, sf_dir, "labels")).where("predicted = 1"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later similar lines leave the texts; a document stays even if its text is then empty, null texts stay null."""
    return _documents(lines.dedup_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least id) of each group stays; shingles of five words, similarity 0.8. Documents without words and with null ids stay, of rows that repeat id and text one does."""
    docs, key, _ = keyed(docs, "doc_id")
    docs = _distinct(docs, key)
    kept = minhash.near_duplicates(docs, percent=80, id_col=key).where("kept").select(key)
    return _documents(docs.join(kept, key, "left_semi"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are generalised to tags; null texts stay null."""
    return _documents(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's words in bins; documents without words have one empty piece."""
    return packing.best_fit_pack(docs, packing.n_words(F.col("text")))


STAGES = [("quality_classifier", keep_quality), ("line_dedup", drop_lines), ("minhash_near_dedup", drop_near_duplicates), ("pii", sanitise), ("best_fit_packing", pack)]
#: A trained classifier and packing have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each written as Parquet and read again by the next."""
    base = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
