"""Measurement series: steps, noise, and whom a step is credited to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import percent_change, verdict


def last_points(points: DataFrame, series: str, order: str, most: int) -> DataFrame:
    """The most latest points of each series."""
    n = F.row_number().over(Window.partitionBy(series).orderBy(F.desc(order)))
    return points.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def steps(points: DataFrame, series: str, order: str, flat_percent: float, lower_is_better: bool = True) -> DataFrame:
    """Consecutive points of points(series, order, revision, value): kind same_revision or compared, delta, percent (null from zero) and verdict.

    A series is ordered in one task; a point is one measurement, so a series is as short as its measuring was.
    """
    w = Window.partitionBy(series).orderBy(order)
    p = points.select(series, order, "revision", "value", F.lag("revision").over(w).alias("from_revision"), F.lag("value").over(w).alias("before"), F.lag(order).over(w).alias("_o"))
    p = p.where("_o is not null").withColumn("delta", F.col("value") - F.col("before"))
    p = p.withColumn("percent", percent_change(F.col("before"), F.col("value")))
    kind = F.when(F.col("revision") == F.col("from_revision"), "same_revision").otherwise("compared")
    return p.select(series, order, "from_revision", "revision", kind.alias("kind"), "delta", "percent", verdict(F.col("delta"), F.col("percent"), flat_percent, lower_is_better).alias("verdict"))


def noise_floor(steps_: DataFrame, series: str) -> DataFrame:
    """(series, samples, max_abs_percent): the largest change between measurements of one revision; a step within it says nothing."""
    same = steps_.where("kind = 'same_revision'")
    return same.groupBy(series).agg(F.count("*").alias("samples"), F.round(F.max(F.coalesce(F.abs("percent"), F.lit(0.0))), 6).alias("max_abs_percent"))


def credit(steps_: DataFrame, changed: DataFrame, on: list[str]) -> DataFrame:
    """Per symbol, what the steps that changed it moved: changed(*on, symbol) joined with compared steps.

    (symbol, steps, delta_sum, weighted_delta, best_isolation, evidence, improved, regressed, flat): a step's delta is shared
    by all symbols that it changed; best_isolation is the least number of them in a step.
    """
    symbols = changed.select(*on, "symbol").distinct()
    many = symbols.groupBy(*on).agg(F.count("*").alias("n"))
    j = steps_.where("kind = 'compared'").join(many, on).join(symbols, on)
    # Sums of decimals do not depend on the order of rows.
    share = (F.col("delta") / F.col("n")).cast("decimal(28,10)")
    count = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    out = j.groupBy("symbol").agg(
        F.count("*").alias("steps"), F.round(F.sum(F.col("delta").cast("decimal(28,10)")).cast("double"), 4).alias("delta_sum"), F.round(F.sum(share).cast("double"), 4).alias("weighted_delta"),
        F.min("n").alias("best_isolation"), count("improved"), count("regressed"), count("flat"),
    )
    return out.withColumn("evidence", F.when(F.col("best_isolation") <= 1, "isolated").otherwise("co_changed"))
