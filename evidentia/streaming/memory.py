"""Facts with two times: when they hold and when they were recorded; kept over a stream, asked as of any two times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FACT = ["key", "event_id", "valid", "recorded", "value"]
#: Facts that the stream has taken.
TAKEN = "key string, event_id long, valid timestamp, recorded timestamp, value string, taken timestamp"

#: Rows without a key, an id or a time are no facts.
IS_FACT = "key is not null and event_id is not null and valid is not null and recorded is not null"


def take(facts: DataFrame, late_ms: int) -> DataFrame:
    """Of a stream of facts(key, event_id, valid, recorded, value) those that are taken: each once, none recorded over late_ms before the watermark; taken is when its batch was.

    What was taken is remembered until no repetition can come in time, by Spark's own state: no task calls for it fact by fact.
    """
    marked = facts.where(IS_FACT).withWatermark("recorded", f"{late_ms} milliseconds")
    return marked.select(*FACT).dropDuplicatesWithinWatermark(FACT).withColumn("taken", F.current_timestamp())


def keep(spark: SparkSession, facts: DataFrame, folder: str, late_ms: int) -> DataFrame:
    """Take what facts, a stream, has to give now, and return all facts that were ever taken into folder.

    folder, which the caller names and keeps, holds the taken facts and the stream's state: another call goes on where the last one ended, and a
    call that was broken off takes nothing twice. An event_id of a key is one fact, that of its first batch, then recorded first. head tells whether
    a fact was the key's latest when it came, before is the one that it took over from; who reads neither has them not worked out.
    """
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        query = take(facts, late_ms).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").format("parquet").option("path", f"{folder}/taken").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    taken = spark.read.schema(TAKEN).parquet(f"{folder}/taken")
    d = taken.groupBy("key", "event_id").agg(F.min(F.struct("taken", "recorded", "valid", "value")).alias("m")).select("key", "event_id", "m.*")
    # Facts of a batch come in order of recording.
    earlier = Window.partitionBy("key").orderBy("taken", "recorded", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    order = F.struct("valid", "recorded", "event_id")
    d = d.withColumn("_last", F.max(order).over(earlier)).withColumn("head", F.col("_last").isNull() | (order > F.col("_last")))
    return d.select(*FACT, "head", F.when(F.col("head"), F.col("_last.event_id")).alias("before"))


def as_of(facts: DataFrame, valid_at, recorded_at) -> DataFrame:
    """(key, event_id, valid, recorded, value): what was known at recorded_at to hold at valid_at: of each key the latest valid fact, then the last recorded, then the greatest id.

    One aggregate with a row a key before the exchange, over facts of a table or of keep(); a repeated event_id is one fact.
    """
    f = facts.where(IS_FACT).where((F.col("valid") <= F.lit(valid_at).cast("timestamp")) & (F.col("recorded") <= F.lit(recorded_at).cast("timestamp")))
    best = f.groupBy("key").agg(F.max(F.struct("valid", "recorded", "event_id", "value")).alias("m"))
    return best.select("key", "m.event_id", "m.valid", "m.recorded", "m.value")


def corrections(facts: DataFrame) -> DataFrame:
    """(key, valid, event_id, recorded, recorded_to, value): each version of what a key was said to be from a time on, and when a later record replaced it (null: it stands)."""
    by = Window.partitionBy("key", "valid").orderBy("recorded", "event_id")
    return facts.where(IS_FACT).dropDuplicates(["key", "event_id"]).select("key", "valid", "event_id", "recorded", F.lead("recorded").over(by).alias("recorded_to"), "value")
