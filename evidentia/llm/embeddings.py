"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, keyed, table

SAMPLE = 20_000
#: Share of pairs exactly at the threshold that meet as candidates, and the tables spent on it before substrings get shorter.
RECALL, MAX_TABLES = 0.95, 128


def learn_rotation(x: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """Rotation whose signs quantise x with least error (alternating codes and orthogonal Procrustes)."""
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(rounds if len(x) else 0):
        u, _, vt = np.linalg.svd(x.T @ np.sign(x @ r))
        r = u @ vt
    return r


def threshold_pairs(x: np.ndarray, threshold: float, n: int = 2_000) -> list[tuple[np.ndarray, np.ndarray]]:
    """n unit rows of x with partners at cosine threshold: one lot turned at random, one towards other rows of x."""
    rng = np.random.default_rng(7)
    a = np.resize(x, (n, x.shape[1]))
    out = []
    for u in (rng.standard_normal(a.shape), a[rng.permutation(n)]):
        u = u - (u * a).sum(1, keepdims=True) * a
        length = np.linalg.norm(u, axis=1)
        far = length > 1e-6
        if far.any():
            out.append((a[far], threshold * a[far] + math.sqrt(1 - threshold**2) * u[far] / length[far, None]))
    return out


class Plan:
    """Rotations, learnt as they are needed, and for each substring length how many are used to reach RECALL."""

    def __init__(self, x: np.ndarray, threshold: float, rotations: int):
        self.x, self.dim, self.least, self.rotations = x, x.shape[1], rotations, []
        self.p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
        self.pairs = threshold_pairs(x, threshold)

    def rotation(self, count: int) -> np.ndarray:
        while len(self.rotations) < count:
            self.rotations.append(learn_rotation(self.x, len(self.rotations)))
        return np.hstack(self.rotations[:count])

    def reach(self, bits: int, count: int) -> int:
        """Expected flips at the threshold over all substrings, and five deviations more."""
        total = max(1, count * self.dim // bits) * min(bits, count * self.dim)
        return int(total * self.p + 5 * math.sqrt(count * total * self.p * (1 - self.p)))

    def recall(self, bits: int, count: int) -> float:
        rot = self.rotation(count)
        found = [1.0]
        for a, b in self.pairs:
            x, y = keys(a @ rot > 0, bits), keys(b @ rot > 0, bits)
            found.append(float(((x == y).any(1) & (np.bitwise_count(x ^ y).sum(1) <= self.reach(bits, count))).mean()))
        return min(found)

    def choose(self, bits: int) -> tuple[int, int, int]:
        """(bits, rotations, reach): the expected number of tables, more while the measured recall is short, then shorter substrings."""
        while True:
            hit = (1 - self.p) ** bits
            tables = math.ceil(math.log(1 - RECALL) / math.log1p(-hit)) if hit < 1 else 1
            count = max(self.least, -(-tables * bits // self.dim))
            while bits == 1 or count == self.least or count * self.dim // bits <= MAX_TABLES:
                if bits == 1 or self.recall(bits, count) >= RECALL:
                    return bits, count, self.reach(bits, count)
                count += 1
            bits -= 1


def keys(signs: np.ndarray, bits: int) -> np.ndarray:
    """The rows' signs cut into whole substrings of bits, as numbers; a rest is left out."""
    bits = min(bits, signs.shape[1])
    n = signs.shape[1] // bits
    return signs[:, : n * bits].reshape(len(signs), n, bits) @ (1 << np.arange(bits, dtype=np.int32))


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", rotations: int = 4, sample: int = SAMPLE) -> DataFrame:
    """Per row: id, n_links, component_id, kept; links join rows of one non-null label with cosine >= threshold.

    Rotations are learnt on the sample rows with the least id hash (all are indexed). Signs under
    them give the codes, cut into substrings of about log2(rows of the label) bits; rows that share a
    substring are candidates, met at the first shared one, and kept if the codes' Hamming distance is plausible.
    The longer a label's substrings, the more rotations it uses (rotations at least): so many that RECALL
    of the sample's pairs at the threshold meet. So recall does not fall as a label grows.
    Cosines come from the original vectors in double precision, so no false link is made. Equal
    vectors form a class and are not expanded into pairs. Null, zero, or non-finite vectors, and
    null labels, have no links. Of rows with one id, one goes by it; the others, and rows with null ids, go by numbers
    beyond all ids. Other columns are not read; no rows give no rows.
    """
    vectors, key, _ = keyed(vectors, id_col)
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).alias("id"), F.col(id_col).cast("long").alias("own"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    fine = F.col("label").isNotNull() & F.col("v").isNotNull() & F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    marked = rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("digest", F.when(F.col("fine"), F.sha2(F.to_json("v"), 256)))
    good = marked.where("fine")
    classes = cut(good.groupBy("label", "digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")))
    # Substring length by the label's number of distinct vectors.
    wanted = F.least(F.lit(24), F.greatest(F.lit(8), F.ceil(F.log2("n")))).cast("int")
    sizes = cut(classes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).select("label", "d", wanted.alias("bits")))
    stats = sizes.agg(F.max("d"), F.collect_set("bits"), F.count("*")).first()
    if stats[0] is None:
        return rows.select(F.col("own").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    dim = stats[0]
    got = classes.where(F.size("v") == dim).orderBy(F.xxhash64("rep"), "rep").limit(sample).select("v").toPandas()["v"]
    x = np.array([np.asarray(r, float) for r in got]).reshape(-1, dim)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    plan = Plan(x, threshold, rotations)
    chosen = {b: plan.choose(b) for b in sorted(stats[1])}
    rot = plan.rotation(max(count for _, count, _ in chosen.values()))
    # Few labels, as a rule; very many are joined by exchange.
    labels = sizes.select("label", "bits")
    sized = classes.select("label", "rep", "v").join(F.broadcast(labels) if stats[2] <= 10_000 else labels, "label")

    def encode(batches):
        for pdf in batches:
            unit = np.zeros((len(pdf), dim))
            for i, vec in enumerate(pdf["v"]):
                a = np.asarray(vec, float)
                unit[i, : len(a)] = a / np.abs(a).max()
            for wish, at in pdf.groupby("bits").indices.items():
                bits, count, reach = chosen[wish]
                cut_up = keys(unit[at] @ rot[:, : count * dim] > 0, bits)
                yield pd.DataFrame({"label": pdf["label"].to_numpy()[at], "rep": pdf["rep"].to_numpy()[at], "keys": list(cut_up), "reach": reach})

    coded = sized.mapInPandas(encode, "label string, rep long, keys array<int>, reach int")
    spread = cut(coded).select("label", "rep", "keys", "reach", F.posexplode("keys").alias("t", "key"))
    a, b = spread.alias("a"), spread.alias("b")
    first = F.expr("forall(sequence(0, a.t), i -> i = a.t or a.keys[i] <> b.keys[i])")
    flips = F.expr("aggregate(zip_with(a.keys, b.keys, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    on = (F.col("a.label") == F.col("b.label")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") < F.col("b.rep"))
    near = a.join(b, on & first & (flips <= F.col("a.reach"))).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
    # Component-wise scaling by the largest magnitude first, so squares neither overflow nor vanish.
    unit = classes.select("rep", "copies", F.expr("transform(v, x -> x / array_max(transform(v, y -> abs(y))))").alias("v"))
    unit = unit.withColumn("norm", F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + x * x))"))
    pairs = near.join(unit.select(F.col("rep").alias("a"), F.col("v").alias("x"), F.col("norm").alias("p"), F.col("copies").alias("ca")), "a")
    pairs = pairs.join(unit.select(F.col("rep").alias("b"), F.col("v").alias("y"), F.col("norm").alias("q"), F.col("copies").alias("cb")), "b")
    cosine = F.expr("aggregate(zip_with(x, y, (i, j) -> i * j), 0D, (s, z) -> s + z) / (p * q)")
    links = cut(pairs.where("size(x) = size(y)").where(cosine >= threshold).select("a", "b", "ca", "cb"))
    degree = links.select(F.col("a").alias("rep"), F.col("cb").alias("k")).union(links.select("b", "ca")).groupBy("rep").agg(F.sum("k").alias("k"))
    reps = classes.select("label", "digest", "rep", "copies").join(degree, "rep", "left").join(components(links).withColumnRenamed("id", "rep"), "rep", "left")
    reps = reps.select("label", "digest", (F.coalesce("k", F.lit(0)) + F.col("copies") - 1).alias("k"), F.coalesce("component", "rep").alias("c"))
    out = marked.select("id", "own", "label", "digest").join(reps, ["label", "digest"], "left")
    return out.select(F.col("own").alias(id_col), F.coalesce("k", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"), (F.coalesce("c", "id") == F.col("id")).alias("kept"))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of all vectors; see near_vectors."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
