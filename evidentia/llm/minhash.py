"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, cut_table, keyed, mix, small, table

WORDS = 5
PERCENT = 85
BANDS, ROWS = 24, 5
#: Bits of the sketches that candidate pairs and rows of crowded buckets carry.
LONG, SHORT = 2048, 512


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, no words none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(map(digest, w), np.uint64, len(w))
    k = min(words, len(w))
    s = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):  # the mixing in between makes the order of the words count
        s = mix(s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(s)] + np.uint64(k))
    return np.unique(s)


def signatures(sets: list[np.ndarray], m: int = BANDS * ROWS, block: int = 1 << 15) -> np.ndarray:
    """SuperMinHash of each set, shape (sets, m).

    Element e's j-th draw r + j goes to slot p[j] of e's own random permutation p, built step by
    step; a set is done once all its slots hold values under j, as later draws are larger.
    Elements go through in blocks, so a very long set needs no more memory than a block.
    """
    h = np.full((len(sets), m), np.inf)
    elements = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for at in range(0, len(elements), block):
        e, o = elements[at : at + block], owners[at : at + block]
        perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(e), 1))
        live = np.arange(len(e))
        for j in range(m):
            if j:
                first = int(o[live[0]])
                worst = h[first : int(o[live[-1]]) + 1].max(1)
                live = live[worst[o[live] - first] >= j]
                if not len(live):
                    break
            x = mix(e[live] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            k = j + ((x & np.uint64(0xFFFFF)) % np.uint64(m - j)).astype(np.int64)
            slot = perm[live, k]
            perm[live, k] = perm[live, j]
            r = (mix(x) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            np.minimum.at(h.reshape(-1), o[live] * m + slot, r + j)
    return h


def _band_keys(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(h).view(np.uint64).reshape(len(h), bands, rows)
    key = np.zeros((len(h), bands), np.uint64)
    for i in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, i])
    return mix(key + np.arange(bands, dtype=np.uint64)).view(np.int64)  # a band's number is part of its keys


def sketch(s: np.ndarray, bits: int) -> np.ndarray:
    """Longs whose bits tell whether an odd number of elements hash there: sets differ in at least as many elements as sketches in bits."""
    return np.packbits((np.bincount(((s >> np.uint64(7)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).view(np.int64)


def _describe(bands: int, rows: int, words: int):
    def run(batches):
        for pdf in batches:
            sets = [shingles(t, words) for t in pdf["text"]]
            keys = _band_keys(signatures(sets, bands * rows), bands, rows) if len(sets) else np.empty((0, bands), np.int64)
            yield pd.DataFrame({
                "id": pdf["id"], "n": [len(s) for s in sets], "digest": [xxhash.xxh128_digest(s.tobytes()) for s in sets], "keys": list(keys),
                "bits": [sketch(s, LONG) for s in sets], "fold": [sketch(s, SHORT) for s in sets],
            })
    return run


def _sets(words: int):
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "set": [shingles(t, words).view(np.int64) for t in pdf["text"]]})
    return run


def _bound(x: str, y: str, bits: str, percent: int) -> str:
    """Whether rows x and y can be linked, by size and by the bits in which their sketches differ; false for none that are."""
    n, m = f"{x}.n", f"{y}.n"
    flips = f"aggregate(zip_with({x}.{bits}, {y}.{bits}, (i, j) -> bit_count(i ^ j)), 0, (s, z) -> s + z)"
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) and {flips} * {100 + percent} <= ({n} + {m}) * {100 - percent}"


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, rounds: int = 2) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id, kept. Links: 100 * shared >= percent * union of the shingle sets.

    Equal sets form a class, of which the least id stands for all. Each bucket of a band holds
    class representatives only; it is checked in rounds, every member against the bucket's
    first one, and members already in one component are not compared again, so a bucket of copies
    costs a few rows per member. After the rounds, the members of a bucket that still lie in
    unlike components are compared with each other. Sketches bound the likeness before full sets are read;
    links are confirmed on the full sets, whose shingles are known by 64-bit hashes.
    Null or wordless texts have n_shingles 0 and their own component; long texts are read whole. Of rows with one id, one
    goes by it; the others, and rows with null ids, go by numbers beyond all ids. Other columns are not read; no rows give no rows.
    """
    docs, key, same = keyed(docs, id_col)
    d = docs.select(F.col(key).alias("id"), F.col(text_col).alias("text"))
    described = cut_table(d.mapInPandas(_describe(bands, rows, words), "id long, n long, digest binary, keys array<long>, bits array<long>, fold array<long>"))
    firsts = cut(described.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep")))
    reps = cut_table(described.drop("digest").join(firsts.select(F.col("rep").alias("id")), "id", "left_semi"))
    buckets = reps.select(F.col("id").alias("v"), F.explode("keys").alias("key"))
    # Buckets with one member are most of all; only the others are kept.
    crowded = buckets.groupBy("key").agg(F.min("v").alias("h"), F.count("*").alias("size")).where("size > 1").select("key", "h")
    members = cut_table(buckets.join(crowded, "key").where("v <> h"))
    pairs = members.select(F.col("h").alias("a"), F.col("v").alias("b"))
    rest = members.select("key", "v")  # the head has met all others
    links, labels = None, None
    for turn in range(rounds + 1):
        found = cut(_confirm(d, _possible(pairs.distinct(), reps, percent), percent, words))
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = components(links)
        if turn == rounds:
            break
        m = rest.withColumn("c", F.col("v")) if labels is None else rest.join(labels.withColumnRenamed("id", "v"), "v", "left").withColumn("c", F.coalesce("component", "v")).drop("component")
        heads = m.groupBy("key").agg(F.min(F.struct("v", "c")).alias("h"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key", "h")
        open_ = cut_table(m.join(heads, "key"))
        if open_.isEmpty():
            break
        if turn < rounds - 1:
            pairs = open_.where("c <> h.c").select(F.col("h.v").alias("a"), F.col("v").alias("b"))
        else:
            # What few rounds did not settle: members of unlike components, under the short sketches.
            full = open_.select("key", "v", "c").join(reps.select(F.col("id").alias("v"), "n", "fold"), "v")
            x, y = full.alias("x"), full.alias("y")
            pairs = x.join(y, F.expr(f"x.key = y.key and x.v < y.v and x.c <> y.c and {_bound('x', 'y', 'fold', percent)}")).select(F.col("x.v").alias("a"), F.col("y.v").alias("b"))
        rest = open_.where("v <> h.v").select("key", "v")
    by = firsts
    if labels is not None:
        by = by.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    else:
        by = by.withColumnRenamed("rep", "component")
    out = described.select("id", "n", "digest").join(by, "digest", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    if same:
        out = out.withColumn("own", F.col("id"))
    else:
        out = out.join(docs.select(F.col(key).alias("id"), F.col(id_col).cast("long").alias("own")), "id")
    return out.select(F.col("own").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def _possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and long sketches allow to be linked."""
    facts = reps.select("id", "n", "bits")
    x, y = facts.withColumnRenamed("id", "a").alias("x"), facts.withColumnRenamed("id", "b").alias("y")
    both = pairs.join(x, "a").select("b", F.struct("a", "n", "bits").alias("x")).join(y.select("b", F.struct("n", "bits").alias("y")), "b")
    return cut(both.where(_bound("x", "y", "bits", percent)).select("x.a", "b"))


def _confirm(d: DataFrame, pairs: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs whose full sets meet the bound; sets are made of the texts in pairs only."""
    wanted = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    sets = cut_table(d.join(small(wanted), "id", "left_semi").mapInPandas(_sets(words), "id long, set array<long>"))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def op4_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of all documents; see near_duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"))
