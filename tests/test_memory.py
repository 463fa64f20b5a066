"""Facts of two times: the stream against the batch, late and repeated facts, and a second run."""

import random

from pyspark.sql import functions as F

from evidentia.streaming import memory

SCHEMA = "key string, event_id long, valid timestamp, recorded timestamp, value string"
DAY = 86_400_000


def write(spark, path, rows):
    d = spark.createDataFrame([(k, i, v, r, x) for k, i, v, r, x in rows], "key string, event_id long, v long, r long, value string")
    d.select("key", "event_id", F.timestamp_seconds("v").alias("valid"), F.timestamp_seconds("r").alias("recorded"), "value").coalesce(1).write.parquet(path)


def brute(rows, valid_at, recorded_at):
    out = {}
    for k, i, v, r, x in rows:
        if k is not None and v is not None and v <= valid_at and r <= recorded_at and (k not in out or (v, r, i) > out[k][:3]):
            out[k] = (v, r, i, x)
    return {(k, i, x) for k, (_, _, i, x) in out.items()}


def answer(spark, facts, valid_at, recorded_at):
    at = lambda s: spark.range(1).select(F.timestamp_seconds(F.lit(s))).first()[0]
    return {(r["key"], r["event_id"], r["value"]) for r in memory.as_of(facts, at(valid_at), at(recorded_at)).collect()}


def test_stream_and_batch_agree_and_resume(spark, tmp_path):
    rng, day = random.Random(1), 86_400
    facts = [(rng.choice("abcd"), i, day * rng.randrange(1, 60), day * (100 + i // 10) + rng.randrange(3_000), f"x{i}") for i in range(200)]
    first, second = facts[:120], facts[120:]
    write(spark, f"{tmp_path}/in/f1", first + first[:7] + [(None, 900, day, day * 100, "no key"), ("a", 901, None, day * 100, "no time")])
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/f*")
    kept = memory.keep(spark, stream(), f"{tmp_path}/kept", 2 * DAY)
    assert kept.count() == 120
    for v, r in ((30, 104), (59, 200), (5, 101), (0, 0)):
        assert answer(spark, kept, v * day, r * day) == brute(first, v * day, r * day) == answer(spark, spark.read.parquet(f"{tmp_path}/in/f1"), v * day, r * day)
    # More facts, some of them again, and one recorded long before the watermark.
    write(spark, f"{tmp_path}/in/f2", second + first[-5:] + [("a", 950, day * 59, day * 10, "late")])
    kept = memory.keep(spark, stream(), f"{tmp_path}/kept", 2 * DAY)
    assert kept.count() == 200 and kept.where("event_id = 950").count() == 0
    for v, r in ((30, 104), (59, 200), (40, 113)):
        assert answer(spark, kept, v * day, r * day) == brute(facts, v * day, r * day)
    # The state of the first run went on: a key's heads follow one another.
    heads = {r["event_id"]: r for r in kept.where("head").collect()}
    for k in "abcd":
        own = sorted((r["valid"], r["recorded"], r["event_id"]) for r in heads.values() if r["key"] == k)
        assert [heads[i]["before"] for _, _, i in own] == [None, *[i for _, _, i in own[:-1]]]
    assert memory.keep(spark, stream(), f"{tmp_path}/kept", 2 * DAY).count() == 200


def test_corrections(spark, tmp_path):
    write(spark, f"{tmp_path}/c", [("a", 1, 10, 100, "x"), ("a", 2, 10, 200, "y"), ("a", 2, 10, 200, "y"), ("a", 3, 20, 150, "z")])
    got = {(r["event_id"], r["n"]) for r in memory.corrections(spark.read.parquet(f"{tmp_path}/c")).select("event_id", F.col("recorded_to").cast("long").alias("n")).collect()}
    assert got == {(1, 200), (2, None), (3, None)}


def test_facts_are_taken_by_native_state(spark, tmp_path):
    """No task asks for state fact by fact; of an id that says different things in one batch the one recorded first is the fact."""
    write(spark, f"{tmp_path}/in/f1", [("a", 1, 20, 300, "late"), ("a", 1, 10, 200, "first"), ("a", 2, 15, 250, None), ("a", 2, 15, 250, None)])
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/f*")
    assert "Python" not in memory.take(stream, DAY)._jdf.queryExecution().analyzed().toString()
    kept = memory.keep(spark, stream, f"{tmp_path}/kept", DAY)
    assert sorted((r["event_id"], r["value"], r["head"], r["before"]) for r in kept.collect()) == [(1, "first", True, None), (2, None, True, 1)]
