"""Carried values against a loop."""

import random

from evidentia.operators import carry, joins


def test_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(i, p, rng.choice([None, None, None, f"v{p}"])) for i in ("a", "b") for p in rng.sample(range(-40, 300), 120)]
    d = spark.createDataFrame([*rows, ("c", 1, None)], "id string, pos long, v string")
    for block in (1, 7, 1_000):
        for before in (False, True):
            want, last = set(), {}
            for i, p, v in sorted([*rows, ("c", 1, None)], key=lambda r: (r[0], r[1])):
                if before:
                    want.add((i, p, last.get(i)))
                last[i] = v or last.get(i)
                if not before:
                    want.add((i, p, last[i]))
            assert {(r["id"], r["pos"], r["carried"]) for r in carry.carry_forward(d, "v", block, before).collect()} == want
    assert carry.carry_forward(d.limit(0), "v").count() == 0


def test_coverage(spark):
    text = "TN:\nDA:1,1\nSF:lost.c\nDA:1,5\nSF:src\\a.c\nDA:1,0\nDA:2,7\nDA:3,x\nDA:4\nend_of_record\nDA:9,9\nend_of_record\nSF:b.c\nend_of_record\r\nSF:open.c\nDA:1,1"
    lines = carry.lines_of(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string"))
    assert {tuple(r) for r in carry.coverage_records(lines).collect()} == {(1, 4, "src/a.c", 4, 1), (1, 12, "b.c", 0, 0)}


def test_backtrace(spark):
    text = "thread panicked\n   0: core::panic\n             at /rust/core.rs:10:5\n   1: app::run::{closure}\n   2: 0x55aa - app::main\n             at ./src/main.rs:7\n             at ./src/none.rs:8:1\nnote"
    got = [tuple(r)[2:] for r in carry.backtrace_frames(carry.lines_of(spark.createDataFrame([(1, text)], "id int, text string"))).orderBy("pos").collect()]
    assert got == [("core::panic", "/rust/core.rs", 10), ("app::main", "./src/main.rs", 7), (None, "./src/none.rs", 8)]


def test_blocks_are_carried_over_in_blocks(spark, monkeypatch):
    """With more blocks than a task takes, blocks are carried over like rows, and rows are dealt to more tasks."""
    monkeypatch.setattr(carry, "TASK_ROWS", 6)
    monkeypatch.setattr(joins, "TASK_ROWS", 6)
    rng = random.Random(4)
    rows = [(i, p, rng.choice([None] * 5 + [f"v{p}"])) for i in ("a", "b") for p in rng.sample(range(-40, 300), 60)]
    want, last = set(), {}
    for i, p, v in sorted(rows, key=lambda r: (r[0], r[1])):
        want.add((i, p, last.get(i)))
        last[i] = v or last.get(i)
    got = carry.carry_forward(spark.createDataFrame(rows, "id string, pos long, v string"), "v", 3, True)
    assert {(r["id"], r["pos"], r["carried"]) for r in got.collect()} == want
    text = "\n".join(f"SF:f{k}\nDA:1,{k % 2}\nDA:2,0\nend_of_record" for k in range(20))
    lines = carry.lines_of(spark.createDataFrame([(1, text)], "id int, text string"))
    assert {tuple(r) for r in carry.coverage_records(lines).collect()} == {(1, 4 * k, f"f{k}", 2, k % 2) for k in range(20)}
