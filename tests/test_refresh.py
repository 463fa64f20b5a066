"""Refreshed answers against full ones."""

import random

import pytest

from evidentia.operators import refresh


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_counts_follow_the_difference(spark):
    rng = random.Random(3)
    edge = lambda: (rng.choice("abc"), rng.choice(["x", "y", None]), rng.choice(["k", "l"]), rng.choice(["p", None]))
    cols = "src string, dst string, kind string, evidence string"
    before = [edge() for _ in range(60)]
    removed, added = before[:20], [edge() for _ in range(15)] + before[:3]
    after = before[20:] + added
    one = lambda r: refresh.signed(spark.createDataFrame([], cols), spark.createDataFrame(r, cols))
    delta = refresh.signed(spark.createDataFrame(removed, cols), spark.createDataFrame(added, cols))
    owners = spark.createDataFrame([("a", "A"), ("b", "A"), ("c", "C"), ("x", "A"), ("y", "C")], "id string, owner string")
    for make, keys in ((refresh.degree_keys, ["id", "direction"]), (refresh.census_keys, ["census", "name"]), (lambda e: refresh.quotient_keys(e, owners), ["src", "dst", "kind"])):
        old = refresh.count_all(make(one(before)), keys)
        assert rows(refresh.refresh_counts(old, make(delta), keys)) == rows(refresh.count_all(make(one(after)), keys))
        assert rows(refresh.refresh_counts(old, make(one([])), keys)) == rows(old)
    gone = refresh.signed(spark.createDataFrame([("q", "q", "q", "q")], cols), spark.createDataFrame([], cols))
    with pytest.raises(Exception, match="never counted"):
        refresh.refresh_counts(refresh.count_all(refresh.degree_keys(one(before)), ["id", "direction"]), refresh.degree_keys(gone), ["id", "direction"]).collect()


def test_changed_files(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", None), ("e", "1"), ("e", "1")], "path string, digest string")
    after = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "3"), ("f", None)], "path string, digest string")
    assert rows(refresh.changed_files(before, after)) == {("b", "modified"), ("d", "modified"), ("e", "removed"), ("f", "added")}
