"""Answers kept up to date over a stream of event files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cuts import shared_folder


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """The event files that a glob path fits, as a stream; new files are read as they come."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def latest_by_key(events: DataFrame, keys: list[str], at: str, tie: str, columns: list[str]) -> DataFrame:
    """The latest row of each key, ties by tie; the same plan over a stream keeps one row of state a key."""
    best = events.groupBy(*keys).agg(F.max(F.struct(at, tie, *columns)).alias("m"))
    return best.select(*keys, F.col(f"m.{tie}").alias(tie), *[F.col(f"m.{c}").alias(c) for c in columns])


def hourly_counts(events: DataFrame, at: str, by: str, late: str) -> DataFrame:
    """Counts by hour; over a stream, an hour is closed once events are late past it."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 hour").alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), by, "n")


def run_available(spark: SparkSession, answer: DataFrame, mode: str) -> DataFrame:
    """Read all that is there through the stream's plan, and return the table that it leaves.

    complete and update answers are written anew by each batch (a batch that runs again writes the same), append ones grow.
    """
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    written: list[int] = []

    def keep(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/batch={n}")
        written.append(n)

    writer = answer.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").start()
    else:
        query = writer.foreachBatch(keep).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(answer.schema).parquet(f"{base}/out")
    return spark.read.parquet(f"{base}/batch={max(written)}") if written else spark.createDataFrame([], answer.schema)
