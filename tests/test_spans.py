"""Positions in spans against a scan of all of them."""

import random

from pyspark.sql import functions as F

from evidentia.operators import joins, source, spans

SPAN = "file string, name string, start long, end long"


def brute(rows, points):
    out = {}
    for f, at in points:
        hit = [(e - s, n, s, e) for g, n, s, e in rows if g == f and (s <= at < e or s == e == at)]
        if hit:
            out[f, at] = min(hit)[1:]
    return out


def found(df):
    return {(r["file"], r["at"]): (r["name"], r["start"], r["end"]) for r in df.collect()}


def test_blocks_make_up_the_span(spark):
    rows = [(s, e) for s in range(-9, 20, 2) for e in range(s, 40, 3)] + [(0, 1 << 40), (5, 5)]
    for r in spark.createDataFrame(rows, "s long, e long").select("s", "e", spans.blocks(F.col("s"), F.col("e"), 42).alias("b")).collect():
        assert sum(1 << b["level"] for b in r["b"]) == r["e"] - r["s"] and len(r["b"]) <= 82
        if r["e"] - r["s"] < 100:
            assert sorted(p for b in r["b"] for p in range(b["at"] << b["level"], (b["at"] + 1) << b["level"])) == list(range(r["s"], r["e"]))


def test_positions(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT", 5)
    monkeypatch.setattr(joins, "HOT_KEYS", 3)
    rng = random.Random(6)
    rows = [(rng.choice("ab"), f"s{rng.randrange(9)}", s, s + rng.choice([0, 1, 2, 7, 60, 500])) for s in (rng.randrange(-20, 600) for _ in range(300))]
    points = [(rng.choice("abc"), rng.randrange(-30, 700)) for _ in range(500)]
    d = spark.createDataFrame([*rows, ("a", "back", 9, 3), (None, "x", 0, 9)], SPAN)
    p = spark.createDataFrame([*points, (None, 3), ("a", None)], "file string, at long")
    assert found(source.at_position(d, p)) == brute(rows, points)
    assert source.at_position(d.limit(0), p).count() == source.at_position(d, p.limit(0)).count() == 0


def test_a_file_with_very_many_spans(spark):
    d = spark.range(200_000).select(F.lit("f").alias("file"), F.concat(F.lit("s"), "id").alias("name"), F.col("id").alias("start"), (F.col("id") + 1 + F.col("id") % 50_000).alias("end"))
    p = spark.range(0, 250_000, 1_000).select(F.lit("f").alias("file"), F.col("id").alias("at"))
    got = {r["at"]: (r["start"], r["end"]) for r in source.at_position(d, p).collect()}
    for at in range(0, 250_000, 25_000):
        hit = [(1 + i % 50_000, f"s{i}", i, i + 1 + i % 50_000) for i in range(max(0, at - 50_000), min(at + 1, 200_000)) if i <= at < i + 1 + i % 50_000]
        assert got.get(at) == (min(hit)[2:] if hit else None)


def test_occurrences_and_references(spark):
    uses = spark.createDataFrame([("f", "x", 3, 5), ("f", "y", 0, 9)], "file string, symbol string, start long, end long")
    own = spark.createDataFrame([("f", "decl", 3, 5), ("f", "inner", 4, 5), ("f", "wide", 0, 90)], "file string, symbol string, start long, end long")
    at = spark.createDataFrame([("f", i) for i in (3, 4, 8, 50, 99)], "file string, at long")
    assert {(r["at"], r["role"], r["symbol"]) for r in spans.occurrence_at(uses, own, at).collect()} == {(3, "usage", "x"), (4, "definition", "inner"), (8, "usage", "y"), (50, "definition", "wide")}
    edges = [(f"s{i % 3}", "t", "calls", "f", i // 2, 0) for i in range(20)] + [("q", "t", "contains", "f", 0, 1), ("q", "u", "calls", "g", None, None)]
    e = spark.createDataFrame(edges, "src string, dst string, kind string, file string, line int, column int")
    subjects = spark.createDataFrame([("t",), ("t",), ("u",), ("none",), (None,)], "symbol string")
    got = spans.references_of(subjects, e, offset=2, limit=3).orderBy("place").collect()
    assert [(r["symbol"], r["place"], r["total"], r["src"], r["line"]) for r in got] == [("t", 3, 10, "s1", 2), ("t", 4, 10, "s0", 3), ("t", 5, 10, "s0", 4)]
    nodes = spark.createDataFrame([("t", "function", "T", "f", 2), ("u", "file", "g", None, 1)], "id string, kind string, label string, file string, line int")
    docs = spark.createDataFrame([("f", "one\ntwo\nthree\nfour")], "file string, text string")
    got = {r["symbol"]: (r["label"], r["relations"], r["source"]) for r in spans.inspect_symbols(subjects, nodes, e, docs, 1).collect()}
    assert got == {"t": ("T", ["in calls 20", "in contains 1"], "one\ntwo\nthree"), "u": ("g", ["in calls 1"], None)}
    assert {tuple(r) for r in spans.owners(nodes).collect()} == {("t", "f"), ("u", "g")}
