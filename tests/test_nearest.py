"""Vector search on a grid and through an index, against numpy."""

import numpy as np
import pytest

import __spark_entry__ as entry
from evidentia.operators import nearest

SF = "/root/testdata/sf0.1"


def frame(spark, v, ids=None):
    return spark.createDataFrame([(int(i), [float(c) for c in x]) for i, x in zip(range(len(v)) if ids is None else ids, v)], "id long, v array<double>")


def exact(v, asked, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for q in asked:
        sim = np.round(u @ u[q], 6)
        sim[q] = -np.inf
        out[q] = sorted(range(len(v)), key=lambda i: (-sim[i], i))[: min(k, len(v) - 1)]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append(r["id"])
    return out


def test_grid(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 100)
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=(700, 8)), np.tile(rng.normal(size=8), (300, 1))])
    asked = list(range(0, 1000, 7))
    got = found(nearest.top_k(frame(spark, v), spark.createDataFrame([(q,) for q in asked], "id long"), 5))
    assert got == exact(v, asked, 5)


def test_index_of_clusters(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 64)
    monkeypatch.setattr(nearest, "TOGETHER", 2)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    v = np.concatenate([centres[rng.integers(0, 30, 1200)] + rng.normal(size=(1200, 16)) * 0.15, np.tile(centres[0], (600, 1))])  # one list of a third of all rows
    index = nearest.build_index(frame(spark, v), lists=16, parts=4, rounds=4)
    assert index.blocks.count() > 16 and sum(len(r["ids"]) // 8 for r in index.blocks.collect()) == len(v)
    probes = nearest.probes_for(index, 10, 0.98)
    asked = list(range(0, 1800, 30))
    got = found(nearest.search(index, index.rows.where("id % 30 = 0"), 10, probes))
    want = exact(v, asked, 10)
    assert probes < 12 and sum(len(set(got[q]) & set(want[q])) for q in asked) >= 0.95 * sum(map(len, want.values()))
    # All lists and all rows reranked: exact, ties included.
    assert found(nearest.search(index, index.rows.where("id % 100 = 0"), 10, 16, 2_000)) == exact(v, list(range(0, 1800, 100)), 10)


def test_index_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, 0.1]), (6, [None, 1.0])], "id long, v array<double>")
    index = nearest.build_index(rows, parts=2)
    assert found(nearest.search(index, rows, 3, 64)) == {1: [5], 5: [1]}
    none = nearest.build_index(rows.limit(0), parts=2)
    assert nearest.search(none, rows, 3, 4).count() == 0 and nearest.top_k(rows.limit(0), rows.select("id"), 3).count() == 0
    with pytest.raises(ValueError):
        nearest.build_index(rows, parts=3)


def test_recall_of_the_query(spark):
    q = entry.queries()
    want = {(r["query_id"], r["vec_id"]) for r in q["vector_topk_exact"](spark, SF).collect()}
    got = {(r["query_id"], r["vec_id"]) for r in q["vector_topk_index"](spark, SF).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.95 * len(want)
