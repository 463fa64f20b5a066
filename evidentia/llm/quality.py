"""Quality scores: random Fourier features, ridge normal equations, isotonic calibration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

N_STATS = 16
#: About this many labelled rows, picked by id hash, fit the model; all do if there are fewer.
FIT_ROWS = 60_000
#: Tasks that the picked rows, a few MB, are summed in.
FIT_TASKS = 8
_KIND = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 mild mark, 6 odd mark, 7 over ASCII
for _c in range(256):
    _ch = chr(_c)
    _KIND[_c] = 7 if _c > 127 else 1 if _ch.islower() else 2 if _ch.isupper() else 3 if _ch.isdigit() else 4 if _ch.isspace() else 5 if _ch in ".,;:'\"?-()" else 6 if _c > 32 else 0


def statistics(text: str | None) -> list[float]:
    """Sixteen statistics of a whole text; an empty one has all zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    if not words:
        return [0.0] * N_STATS
    b = np.frombuffer(raw, np.uint8)
    share = np.bincount(_KIND[b], minlength=8) / len(b)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(words)
    lengths = np.fromiter(map(len, words), float, n)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0
    stops = raw.count(b".") + raw.count(b"!") + raw.count(b"?")
    return [
        np.log1p(n), np.log1p(lengths.mean()), np.log1p(lengths.std()), np.log1p(lengths.max()), distinct / n**0.9, pairs,
        share[2], share[3], share[5], share[6], share[7], share[4], len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))), np.log1p(n / (1 + stops)), float(np.mean(lengths <= 3)),
    ]


def add_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in text])

    return docs.withColumn("_stats", run(text_col))


class Model:
    """Standardised statistics -> cosine features of a Gaussian kernel -> ridge score -> isotonic probability."""

    def __init__(self, mean, scale, features: int = 300, width: float = 5.0, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.standard_normal((len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.beta, self.knots = None, None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.ones((len(z), 1)), np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b))])

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.features(x) @ self.beta
        # A trace of the raw score keeps apart what the isotonic steps level.
        return np.clip(0.998 * np.interp(raw, *self.knots) + 0.002 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points x (ascending) with means y of weights n: knots (x, value)."""
    blocks: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n):
        blocks.append([xi, yi, ni])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            x2, y2, n2 = blocks.pop()
            x1, y1, n1 = blocks.pop()
            w = n1 + n2
            blocks.append([(x1 * n1 + x2 * n2) / w, (y1 * n1 + y2 * n2) / w, w])
    return np.array([p[0] for p in blocks]), np.array([p[1] for p in blocks])


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in pdf["_stats"]]).reshape(-1, N_STATS)


def train(labelled: DataFrame, ridge: float = 1e-3) -> Model | None:
    """Fit on labelled(id, _stats, y 0/1), a bounded sample; None without rows of both labels.

    Rows of fold 0 of an id hash calibrate, the others fit; each of FIT_TASKS tasks sends its
    sums (under a megabyte) to the driver, and the calibration sends at most 1000 bins.
    """
    rows = cut(labelled.withColumn("fold", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)))).coalesce(FIT_TASKS)
    fit = rows.where("fold > 0")
    s = [F.avg(F.col("_stats")[i]) for i in range(N_STATS)] + [F.stddev_pop(F.col("_stats")[i]) for i in range(N_STATS)]
    r = fit.agg(F.count("*"), F.min("y"), F.max("y"), *s).first()
    if not r[0] or r[1] == r[2]:
        return None
    model = Model(np.array(r[3 : 3 + N_STATS], float), np.array([v if v > 1e-9 else 1.0 for v in r[3 + N_STATS :]], float))

    def sums(batches):
        a = b = 0
        for pdf in batches:
            z, y = model.features(_matrix(pdf)), pdf["y"].to_numpy(float)
            a, b = a + z.T @ z, b + z.T @ y
        if np.ndim(a):
            yield pd.DataFrame({"a": [a.tobytes()], "b": [b.tobytes()]})

    got = fit.mapInPandas(sums, "a binary, b binary").collect()
    a = sum(np.frombuffer(g["a"]) for g in got)
    b = sum(np.frombuffer(g["b"]) for g in got)
    model.beta = np.linalg.solve(a.reshape(len(b), -1) + ridge * r[0] * np.eye(len(b)) / 100, b)

    def raw(batches):
        for pdf in batches:
            yield pd.DataFrame({"raw": model.features(_matrix(pdf)) @ model.beta, "y": pdf["y"].astype(float)})

    held = rows.where("fold = 0").mapInPandas(raw, "raw double, y double")
    bins = held.groupBy(F.floor(F.greatest(F.lit(-0.5), F.least(F.lit(1.49), "raw")) * 500).alias("k")).agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("k").collect()
    if bins:
        model.knots = isotonic(*(np.array([g[c] for g in bins], float) for c in ("x", "y", "n")))
    else:
        model.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut_off: float = 0.7) -> DataFrame:
    """docs plus held_out, score, predicted, in which docs' rows and columns stay; columns so named are replaced.

    Fitted only on labelled rows whose crc32(id) mod 4 is not 2 (null labels and ids are left out; of a repeated label
    the greatest counts); without rows of both labels every score is 1. Null and empty texts are scored by their
    all-zero statistics, long texts whole. Null ids are not held out. No rows give no rows.
    """
    held = F.crc32(F.col(id_col).cast("string")) % 4 == 2
    y = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull() & ~held).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max("quality").alias("y"))
    n = y.count()
    # A cut-off on the hash needs no order; the rows picked are so few that their flags go to the texts, not the texts to them.
    picked = y.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, FIT_ROWS / max(1, n))))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    model = train(add_statistics(d.join(F.broadcast(picked), "id")).select("id", "_stats", "y"))

    @F.pandas_udf("double")
    def judge(text: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.ones(len(text)))
        return pd.Series(model.score(np.array([statistics(t) for t in text]).reshape(-1, N_STATS)))

    out = docs.withColumns({"held_out": F.coalesce(held, F.lit(False)), "score": judge(text_col)})
    return out.withColumn("predicted", (F.col("score") >= cut_off).cast("int"))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents; see score_quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
