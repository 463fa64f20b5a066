"""Answers of a new snapshot from the old answers and what changed: signed counts instead of a full run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of files(path, digest) of two snapshots: added, removed or modified. A null digest is equal to itself alone; repeated rows are one."""
    side = lambda d, k: d.groupBy("path").agg(F.max("digest").alias(f"d{k}")).withColumn(f"in{k}", F.lit(True))
    j = side(before, 0).join(side(after, 1), "path", "full_outer")
    change = F.when(F.col("in0").isNull(), "added").when(F.col("in1").isNull(), "removed").when(~F.col("d0").eqNullSafe(F.col("d1")), "modified")
    return j.select("path", change.alias("change")).where("change is not null")


def signed(removed: DataFrame, added: DataFrame) -> DataFrame:
    """The rows of both with sign -1 and 1; rows that both have cancel out in any sum."""
    return added.withColumn("sign", F.lit(1).cast("long")).unionByName(removed.withColumn("sign", F.lit(-1).cast("long")))


def refresh_counts(old: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """old(keys, n) brought up to date by delta(keys, sign): one aggregate over the answers and the changed rows; counts that fall to 0 go.

    The snapshot itself is not read. Null keys are keys. A count below 0 tells that delta removes what old never held, and is an error.
    """
    both = old.select(*keys, F.col("n").cast("long").alias("n")).unionByName(delta.groupBy(*keys).agg(F.sum("sign").alias("n")))
    sums = both.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")
    wrong = F.raise_error(F.lit("what is removed was never counted")).cast("long")
    return sums.select(*keys, F.when(F.col("n") < 0, wrong).otherwise(F.col("n")).alias("n"))


def census_keys(edges: DataFrame) -> DataFrame:
    """(census, name, sign) of signed edges(kind, evidence, sign): what they add to the counts by relation and by evidence."""
    both = F.array(F.struct(F.lit("relation").alias("census"), F.col("kind").alias("name")), F.struct(F.lit("evidence").alias("census"), F.col("evidence").alias("name")))
    return edges.select("sign", F.explode(both).alias("x")).select("x.census", "x.name", "sign")


def degree_keys(edges: DataFrame) -> DataFrame:
    """(id, direction, sign) of signed edges(src, dst, sign)."""
    both = F.array(F.struct(F.col("src").alias("id"), F.lit("out").alias("direction")), F.struct(F.col("dst").alias("id"), F.lit("in").alias("direction")))
    return edges.select("sign", F.explode(both).alias("x")).select("x.id", "x.direction", "sign")


def quotient_keys(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """(src, dst, kind, sign) between the owners of signed edges' ends; owners(id, owner). Ends without an owner and edges within one are left out.

    An owner that changed is a removed and an added edge for each edge at its node, as signed() takes them.
    """
    a, b = owners.toDF("src", "so"), owners.toDF("dst", "do")
    e = edges.join(a, "src").join(b, "dst").where("so <> do")
    return e.select(F.col("so").alias("src"), F.col("do").alias("dst"), "kind", "sign")


def count_all(keys_of_all: DataFrame, keys: list[str]) -> DataFrame:
    """The first answer: as refresh_counts() from nothing."""
    return keys_of_all.groupBy(*keys).agg(F.sum("sign").alias("n"))
