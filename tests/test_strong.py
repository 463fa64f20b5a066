"""Strong components and cycle witnesses against brute force."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from evidentia.operators import joins, strong
from evidentia.plans.graphs import swap_edges


def reach(adj, x):
    seen, stack = {x}, [x]
    while stack:
        for y in adj.get(stack.pop(), ()):
            if y not in seen:
                seen.add(y)
                stack.append(y)
    return seen


def brute(edges):
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
    nodes = {x for e in edges for x in e}
    to = {x: reach(adj, x) for x in nodes}
    return {x: min(y for y in to[x] if x in to[y]) for x in nodes}, adj


def cycle(adj, comp, root):
    """The shortest cycle through root; of equal ones the one with the least predecessors, from the end."""
    before, dist, queue = {}, {root: 0}, deque([root])
    layers = [[root]]
    while True:
        new, home = {}, None
        for x in layers[-1]:
            for y in adj.get(x, ()):
                if y == root:
                    home = x if home is None else min(home, x)
                elif comp[y] == comp[root] and y not in dist:
                    new[y] = min(x, new.get(y, x))
        if home is not None:
            out, at, end = [], home, root
            for step in range(len(layers), 0, -1):
                out.append((root, step, at, end))
                at, end = before.get(at), at
            return set(out)
        for y, x in new.items():
            dist[y], before[y] = len(layers), x
        layers.append(sorted(new))


@pytest.mark.parametrize("n,m,seed", [(12, 14, 1), (40, 50, 2), (60, 75, 3), (30, 90, 4)])
def test_components(spark, monkeypatch, n, m, seed):
    monkeypatch.setattr(joins, "HOT", 4)
    monkeypatch.setattr(joins, "HOT_KEYS", 3)
    rng = random.Random(seed)
    e = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(100, 101), (101, 102), (102, 100), (200, 201), (201, 200), (300, 301), (400, 400)]
    want, adj = brute(e)
    d = spark.createDataFrame([*e, e[0], (None, 3), (3, None)], "src int, dst int")
    got = strong.strong_components(d).cache()
    assert {r["id"]: r["component"] for r in got.collect()} == want and got.count() == len(want)
    roots = {c for x, c in want.items() if x != c}
    assert {tuple(r) for r in strong.shortest_cycles(d, got).collect()} == set().union(*(cycle({a: b - {a} for a, b in adj.items()}, want, r) for r in roots))
    assert {r["component"] for r in strong.shortest_cycles(d, got, 2).collect()} <= roots


def test_long_chains_take_few_rounds(spark):
    n = 100_000
    line = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    ring = spark.range(n).select((F.col("id") + 2 * n).alias("src"), ((F.col("id") + 1) % n + 2 * n).alias("dst"))
    side = spark.range(n).select((F.col("id") + 4 * n).alias("src"), (F.col("id") + 4 * n + 1).alias("dst")).union(spark.createDataFrame([(5 * n, 4 * n + 5), (7, 4 * n)], "src long, dst long"))
    out = strong.strong_components(line.union(ring).union(side))
    assert {(r["component"], r["n"]) for r in out.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").collect()} == {(2 * n, n), (4 * n + 5, n - 4)}


def test_no_edges(spark):
    none = spark.createDataFrame([], "src string, dst string")
    c = strong.strong_components(none)
    assert c.count() == 0 and strong.shortest_cycles(none, c).count() == 0


def test_query_of_cycles(spark):
    sf = "/root/testdata/sf0.001"
    e = [(r["src"], r["dst"]) for r in swap_edges(spark, sf).collect()]
    want, adj = brute(e)
    roots = {c for x, c in want.items() if x != c}
    assert roots and {tuple(r) for r in entry.queries()["swap_cycles"](spark, sf).collect()} == set().union(*(cycle(adj, want, r) for r in roots))
