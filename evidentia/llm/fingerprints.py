"""Document fingerprints: a quartile digest of hashed byte triplets."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, table

BUCKETS = 256


def fingerprint(data: bytes, buckets: int = BUCKETS) -> str:
    """Hex: two digits of log length, then two bits a bucket: its count's quartile among all buckets."""
    b = np.frombuffer(data, np.uint8)
    counts = np.zeros(buckets, np.int64)
    step = 1 << 20
    for i in range(0, max(0, len(b) - 2), step):  # long texts go through in blocks
        x = b[i : i + step + 2].astype(np.uint32)
        key = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
        counts += np.bincount((key * np.uint32(2654435761)) >> np.uint32(32 - buckets.bit_length() + 1), minlength=buckets)
    cuts = np.sort(counts)[[buckets // 4 - 1, buckets // 2 - 1, 3 * buckets // 4 - 1]]
    code = (counts[:, None] > cuts).sum(1).astype(np.uint8).reshape(-1, 4)
    body = (code << np.array([6, 4, 2, 0], np.uint8)).sum(1).astype(np.uint8)
    size = min(255, round(8 * np.log2(1 + len(b))))
    return f"{size:02x}{body.tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """1 for equal digests, less by the quartile steps between buckets and between lengths, never under 0."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    shift = np.array([6, 4, 2, 0], np.uint8)
    d = np.abs(((x[1:, None] >> shift) & 3).astype(int) - ((y[1:, None] >> shift) & 3)).ravel()
    steps = int(np.where(d == 3, 6, d).sum()) + min(abs(int(x[0]) - int(y[0])), 64)
    # Unrelated digests lie about 1.25 steps (with the weight of 6, over 1.6) a bucket apart.
    return max(0.0, 1.0 - steps / (1.7 * len(d)))


#: Characters of text in a range of ids, about; a range goes through one task.
RANGE = 64_000_000


def next_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """(id, own, text, _range, _ahead): docs dealt into id ranges, each with the next range's first row (_ahead true) as its last.

    Only the ranges' first ids come to the driver, one for RANGE characters (least ranges at least). After the last row
    comes the first. Of rows with one id, one goes by it; the others, and rows with null ids, come after all ids.
    """
    docs, key, _ = keyed(docs, id_col)
    d = docs.select(F.col(key).alias("id"), F.col(id_col).cast("long").cast("string").alias("own"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = max(least, -(-(d.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0) // RANGE))
    cuts = d.approxQuantile("id", [i / n for i in range(1, n)], min(0.01, 0.2 / n)) if n > 1 else []
    edges = np.unique(np.clip(np.array(cuts, float), -9.2e18, 9.2e18).astype(np.int64))
    dealt = d.withColumn("_range", F.pandas_udf(lambda s: pd.Series(np.searchsorted(edges, s.to_numpy(), side="left").astype("int32")), "int")("id"))
    firsts = {r["_range"]: r["lo"] for r in dealt.groupBy("_range").agg(F.min("id").alias("lo")).collect()}
    order = sorted(firsts)
    # One row a range, as few as the ranges are.
    ahead = d.sparkSession.createDataFrame([(firsts[r], order[i - 1]) for i, r in enumerate(order)], "id long, _range int")
    copies = d.join(F.broadcast(ahead), "id")
    return dealt.withColumn("_ahead", F.lit(False)).unionByName(copies.withColumn("_ahead", F.lit(True)))


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, its edited text and their likeness; see op3 for the columns.

    One row for each of docs, in the order of next_documents. Null texts are empty; an empty text's digest has all
    buckets at quartile 0; long texts are digested whole. Other columns are not read. No rows give no rows.
    """

    def judge(batches):
        before = None  # (range, id, own, text, fingerprint)
        for pdf in batches:
            out = []
            for rng, ahead, i, own, text in zip(pdf["_range"], pdf["_ahead"], pdf["id"], pdf["own"], pdf["text"]):
                fp = fingerprint(text.encode("utf-8", "surrogatepass"))
                if before is not None and before[0] == rng:
                    _, o0, t0, f0 = before
                    k = len(t0) // 4
                    edited = (t0[: len(t0) - k] + text[:k]).encode("utf-8", "surrogatepass")
                    fe = fingerprint(edited)
                    out.append((o0, len(t0), hashlib.sha256(edited).hexdigest(), f0, fe, likeness(f0, fe), likeness(f0, fp)))
                before = None if ahead else (rng, own, text, fp)
            yield pd.DataFrame(out, columns=["own", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = next_documents(docs, id_col, text_col, n).repartition(F.col("_range")).sortWithinPartitions("_range", "_ahead", "id")
    schema = "own string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = dealt.mapInPandas(judge, schema)
    return out.select(F.col("own").cast("long").alias(id_col), *out.columns[1:])


def op3_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts; see compare_neighbours."""
    return compare_neighbours(table(spark, sf_dir, "documents"))
