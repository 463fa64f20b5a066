"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cuts import cut, cut_table  # noqa: F401

#: ASCII white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
#: Sides of joins up to so many rows of a few longs may be broadcast, after they are counted.
FEW = 500_000
#: A key of more rows than this may be hot; fewer than HOT_KEYS keys are, see lookup().
HOT, HOT_KEYS = 10_000, 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(docs: DataFrame, name: str) -> str:
    """name, or if docs has such a column (in any case), name with a suffix that none has."""
    taken = {c.lower() for c in docs.columns}
    return name if name.lower() not in taken else f"{name}_{uuid.uuid4().hex}"


def keyed(docs: DataFrame, id_col: str) -> tuple[DataFrame, str, bool]:
    """docs plus a column (its name is returned) with a long of its own for each row, and whether that is the id everywhere.

    It is the id where that is not null and stands for the first time; null ids and repeated ones get numbers
    beyond all ids, in no order that matters. Where ids are unique, as a rule, only the ids are counted.
    """
    key, row = fresh(docs, "_key"), fresh(docs, "_row")
    ids = docs.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count("*").alias("n"))
    most, low, high, nulls = ids.agg(F.max("n"), F.min("id"), F.max("id"), F.count_if(F.col("id").isNull())).first()
    if most is None or (most == 1 and not nulls):
        return docs.withColumn(key, F.col(id_col).cast("long")), key, True
    # Written once, as the row numbers must not change between reads.
    rows = cut_table(docs.withColumn(row, F.monotonically_increasing_id()))
    firsts = rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias(f"{row}i")).agg(F.min(row).alias(f"{row}f"), F.count("*").alias(f"{row}n")).where(F.col(f"{row}n") > 1)
    other = F.lit(0 if high is None else high + 1) + F.col(row) if high is None or high < 2**62 else F.lit(low - 1) - F.col(row)
    own = F.col(id_col).isNotNull() & (F.col(f"{row}f").isNull() | (F.col(f"{row}f") == F.col(row)))
    out = rows.join(firsts, F.col(id_col).cast("long") == F.col(f"{row}i"), "left").withColumn(key, F.when(own, F.col(id_col).cast("long")).otherwise(other))
    return out.drop(row, f"{row}i", f"{row}f", f"{row}n"), key, False


def small(df: DataFrame, rows: int = FEW) -> DataFrame:
    """df, marked for broadcast if it is counted to have no more than so many rows; df should be cut, as it is counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lookup(rows: DataFrame, values: DataFrame, on: str, n: str) -> DataFrame:
    """rows left-joined with values, which has one row for each of its keys `on` (null is a key) and, as n, how many of rows have it.

    Keys of many rows are broadcast, so their rows stay where they are; the others are joined by exchange. Many is over
    HOT rows and over a HOT_KEYS-th of all, so fewer than HOT_KEYS keys are broadcast whatever the size. Both sides should be cut.
    """
    many = max(HOT, rows.count() // HOT_KEYS)
    v = values.withColumnRenamed(on, "_on")
    same = F.col(on).eqNullSafe(F.col("_on"))
    hot = F.broadcast(v.where(F.col(n) > many))
    cold = rows.join(hot.select("_on"), same, "left_anti").join(v.where(F.col(n) <= many), same, "left")
    return rows.join(hot, same).unionByName(cold).drop("_on", n)


def words_of(t: Column | str) -> Column:
    """Words between ASCII white space; empty ones may stand among them. A blank is split on faster than a pattern."""
    t = F.col(t) if isinstance(t, str) else t
    odd = [F.contains(t, F.lit(c)) for c in "\t\n\v\f\r"]
    return F.when(odd[0] | odd[1] | odd[2] | odd[3] | odd[4], F.split(t, SPACE)).otherwise(F.split(t, " "))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _forest(batches):
    """Union-find over the edges of one partition: each vertex with its partition-local root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    out = [(x, root(x)) for x in list(parent)]
    yield pd.DataFrame({"a": [x for x, _ in out], "b": [r for _, r in out]}, dtype="int64")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b long): rows (id, component), component the least id reachable.

    Each partition first reduces its edges to a union-find forest; labels then pass along the
    forests' edges and jump to their own label's label until nothing changes, so no component
    is gathered anywhere. Vertices without edges are not returned.
    """
    forest = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInPandas(_forest, "a long, b long"))
    both = forest.where("a <> b").union(forest.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both)
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        seen = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        near = labels.join(seen, "id").select("id", "component", F.least("component", "m").alias("n"))
        jump = labels.select(F.col("id").alias("n"), F.col("component").alias("j"))
        after = cut(near.join(jump, "n").select("id", F.col("component").alias("old"), F.least("n", "j").alias("component")))
        labels = after.select("id", "component")
        if after.where("old <> component").isEmpty():
            return labels
