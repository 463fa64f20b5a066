"""Joins that a hot key does not gather in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cuts import cut

#: A key of more rows than this may be hot; fewer than HOT_KEYS keys are, whatever the size.
HOT, HOT_KEYS = 10_000, 100_000
#: Rows that one task groups or puts in order.
TASK_ROWS = 500_000


def dealt(rows: DataFrame, n: int, *columns: str) -> DataFrame:
    """rows, n in number or about, dealt by columns to as many tasks as keep each at TASK_ROWS; Spark's own number of tasks if that does."""
    tasks = -(-n // TASK_ROWS)
    return rows.repartition(tasks, *columns) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def meet(rows: DataFrame, values: DataFrame, on: str, n: str) -> DataFrame:
    """rows joined with values by a key that is not null; values holds a few rows for a key and, as n, how many of rows have it.

    Keys that over HOT rows and over a HOT_KEYS-th of all have are broadcast, so their rows stay where they are: at most
    HOT_KEYS keys, by their number alone. All others are joined by exchange. Both sides should be cut.
    """
    many = max(HOT, rows.count() // HOT_KEYS)
    hot, cold = values.where(F.col(n) > many).drop(n), values.where(F.col(n) <= many).drop(n)
    keys = F.broadcast(hot.select(on).distinct())
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(keys, on, "left_anti").join(cold, on))


def spread(rows: DataFrame, values: DataFrame, on: str) -> DataFrame:
    """rows joined with values, which has one wide row for a key: a key that many rows have is copied, so that its rows go to several tasks.

    The numbers of copies that are broadcast are fewer than HOT_KEYS. rows should be cut.
    """
    many = max(HOT, rows.count() // HOT_KEYS)
    hot = cut(rows.groupBy(on).agg(F.ceil(F.count("*") / many).cast("int").alias("_c")).where("_c > 1"))
    if hot.isEmpty():
        return rows.join(values, on)
    hot = F.broadcast(hot)
    a = rows.join(hot, on, "left").withColumn("_s", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_c", F.lit(1))).cast("int")).drop("_c")
    b = values.join(hot, on, "left").withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce("_c", F.lit(1)) - 1))).drop("_c")
    return a.join(b, [on, "_s"]).drop("_s")
