"""Clones against brute force written from the definition."""

import random
from collections import defaultdict

import numpy as np
import pytest

from evidentia.operators import clones

WORDS = [f"w{i}" for i in range(400)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edits():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randint(0, 25))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 2)] = [rng.randrange(4)] * rng.randint(0, 2)
        want = edit_distance(a, b)
        for most in (0, 2, 5, 60):
            assert clones.edits(np.array(a, int), np.array(b, int), most) == min(want, most + 1)


def test_words_known_are_not_gone_through_for_each_text():
    class Words(dict):
        def keys(self):
            raise AssertionError("all words")

        __iter__ = keys

    words = Words()
    first = clones._hashed(words, ["a", "b", "a"])
    assert first[0] == first[2] != first[1] and clones._hashed(words, ["b", "c"])[0] == first[1] and len(words) == 3


def test_edits_of_long_rows(monkeypatch):
    """No array of a row's length is made for each token."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 50, 3000)
    b = np.delete(a, rng.choice(3000, 40, replace=False))
    b = np.insert(b, rng.integers(0, len(b), 25), 99)
    monkeypatch.setattr(np, "full", None)
    assert clones.edits(a, b, 600) == edit_distance(a.tolist(), b.tolist()) and clones.edits(a, b, 20) == 21


def test_winnow_keeps_one_of_each_window():
    rng = np.random.default_rng(2)
    for n in (0, 7, 8, 12, 30, 200):
        hashes = rng.integers(0, 5, n).astype(np.uint64)
        at, seeds = clones.winnow(hashes)
        grams = n - clones.GRAM + 1
        assert (len(at) > 0) == (grams > 0)
        for k in range(max(0, grams - clones.WINNOW + 1)):
            assert any(k <= x < k + clones.WINNOW for x in at)
        of = {}
        for x, s in zip(at.tolist(), seeds.tolist()):
            assert of.setdefault(s, hashes[x : x + clones.GRAM].tolist()) == hashes[x : x + clones.GRAM].tolist()


def brute(docs, min_tokens, permille, mode="near_miss", keep=frozenset()):
    """The same definition by plain loops over strings of tokens: fingerprints are compared as the tokens they stand for."""
    read = {i: clones.read_tokens(t or "", mode, keep) for i, t in docs}
    places, order = defaultdict(list), {}
    for i in sorted(read):
        hashes = clones._mix(clones._hashed({}, read[i][0]))
        for at in clones.winnow(hashes)[0].tolist():
            places[tuple(read[i][0][at : at + clones.GRAM])].append((i, at))
    gap, drift = (clones.GAP, clones.DRIFT) if permille < 1000 else (clones.WINNOW, 0)
    matches = defaultdict(lambda: defaultdict(list))
    for occ in places.values():
        occ.sort()
        for k, (i, a) in enumerate(occ):
            for j, b in occ[: min(k, clones.ANCHORS)]:
                if j < i or b + clones.GRAM <= a:
                    matches[i, j][a - b].append(a)
    out = set()
    for (i, j), diagonals in matches.items():
        runs = []
        for d, at in diagonals.items():
            at.sort()
            start = last = at[0]
            for x in at[1:] + [None]:
                if x is None or x - last > gap:
                    runs.append((start, last + clones.GRAM, d))
                    start = x
                last = x
        runs.sort(key=lambda r: (r[0], r[2]))
        groups, most = [], None
        for r in runs:
            if most is None or r[0] - most > gap or abs(r[2] - groups[-1][-1][2]) > drift:
                groups.append([])
            groups[-1].append(r)
            most = max(most or 0, r[1])
        for g in groups:
            s, e = min(r[0] for r in g), max(r[1] for r in g)
            t, f = min(r[0] - r[2] for r in g), max(r[1] - r[2] for r in g)
            if min(e - s, f - t) + 2 * clones.WINNOW < min_tokens:
                continue
            (a, la), (b, lb) = read[i], read[j]
            for _ in range(clones.WINNOW):
                if s and t and a[s - 1] == b[t - 1]:
                    s, t = s - 1, t - 1
            for _ in range(clones.WINNOW):
                if e < len(a) and f < len(b) and a[e] == b[f]:
                    e, f = e + 1, f + 1
            parts = [(s, e, t, f)]
            if permille == 1000:
                parts, x = [], 0
                while x < min(e - s, f - t):
                    y = x
                    while y < min(e - s, f - t) and a[s + y] == b[t + y]:
                        y += 1
                    parts.append((s + x, s + y, t + x, t + y))
                    x = y + 1
            for s2, e2, t2, f2 in parts:
                if min(e2 - s2, f2 - t2) < min_tokens or (i == j and f2 > s2):
                    continue
                compared = max(e2 - s2, f2 - t2)
                distance = edit_distance(a[s2:e2], b[t2:f2])
                if (compared - distance) * 1000 // compared < permille:
                    continue
                def lines(tokens, at, x, y):
                    whole = [n for n in sorted(set(at[x:y])) if all(x <= k < y for k, m in enumerate(at) if m == n)]
                    return (whole[0], whole[-1]) if whole else (at[x], at[y - 1])
                out.add((i, *lines(a, la, s2, e2), j, *lines(b, lb, t2, f2), compared, distance))
    return out


def family_brute(pairs):
    spans = defaultdict(set)
    for i, s, e, j, t, f, *_ in pairs:
        spans[i].add((s, e))
        spans[j].add((t, f))
    member = {}
    for i, own in spans.items():
        group = []
        for s, e in sorted(own):
            if group and s <= max(y for _, y in group):
                group.append((s, e))
            else:
                group = [(s, e)]
            for x in group:
                member[i, *x] = (i, min(a for a, _ in group), max(b for _, b in group))
    member = {k: next(v for (i, s, e), v in member.items() if i == k[0] and v[1] <= k[1] and k[2] <= v[2] and v == max((w for q, w in member.items() if q[0] == k[0] and w[1] <= k[1] and k[2] <= w[2]), key=lambda w: w[2] - w[1])) for k in member}
    root = {m: m for m in member.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s, e, j, t, f, *_ in pairs:
        a, b = find(member[i, s, e]), find(member[j, t, f])
        root[max(a, b)] = min(a, b)
    groups = defaultdict(set)
    for m in root:
        groups[find(m)].add(m)
    return {frozenset(g) for g in groups.values()}


def corpus(rng):
    passage = [rng.choice(WORDS) for _ in range(120)]
    docs = []
    for i in range(26):
        x = [rng.choice(WORDS) for _ in range(rng.randint(0, 90))]
        if i % 2 == 0:
            p = list(passage)
            for _ in range(rng.randint(0, 14)):
                k = rng.randrange(len(p))
                p[k : k + 1] = rng.choice([[], [rng.choice(WORDS)], [p[k], rng.choice(WORDS)]])
            x[len(x) // 2 : len(x) // 2] = p if i % 3 else p[:70]
        if i % 5 == 0:
            x += x[-70:]
        docs.append((f"d{i:02d}", "\n".join(" ".join(x[k : k + 9]) for k in range(0, len(x), 9))))
    return docs + [("null", None), ("empty", ""), ("short", "a b c"), ("same", "la " * 300), ("same2", "la " * 200)]


@pytest.mark.parametrize("mode,similarity", [("near_miss", 80), ("near_miss", 0.95), ("exact", 80), ("renamed", 80)])
def test_pairs_and_families(spark, monkeypatch, mode, similarity):
    from evidentia.operators import joins

    monkeypatch.setattr(joins, "HOT", 5)
    monkeypatch.setattr(joins, "HOT_KEYS", 10)
    docs = corpus(random.Random(4))
    keep = frozenset(WORDS[::2])
    d = spark.createDataFrame(docs, "id string, text string").repartition(3)
    pairs = clones.clone_pairs(d, 50, similarity, mode, keep).cache()
    got = {tuple(r)[:-1] for r in pairs.collect()}
    want = brute(docs, 50, 1000 if mode != "near_miss" else round(similarity * (10 if similarity > 1 else 1000)), mode, keep)
    assert got == want and len(got) > 3
    members, size = clones.families(pairs)
    by = defaultdict(set)
    for r in members.collect():
        by[r["family"]].add((r["id"], r["start_line"], r["end_line"]))
    assert {frozenset(m) for m in by.values()} == family_brute(want)
    for r in size.collect():
        own = by[r["family"]]
        assert (r["members"], r["documents"], r["size"]) == (len(own), len({i for i, _, _ in own}), sum(e - s + 1 for _, s, e in own))


def test_no_documents(spark):
    d = spark.createDataFrame([], "id string, text string")
    members, size = clones.families(clones.clone_pairs(d))
    assert members.count() == size.count() == 0
    with pytest.raises(ValueError):
        clones.clone_pairs(d, mode="other")


def test_suppression(spark):
    docs = spark.createDataFrame([("a", "src/x.router.ts", "if (x)\ny"), ("b", "src/Y.Routes.js", "y"), ("c", "src/data.ts", "k: 1\nl: 2"), ("d", "src/data2.ts", "k: 1"), ("e", "src/user-model.ts", "k: 1"), ("f", "src/run.ts", "return 1")], "id string, path string, text string")
    members = spark.createDataFrame([("F1", "a", 1, 2), ("F1", "b", 1, 1), ("F2", "c", 1, 2), ("F2", "d", 1, 1), ("F3", "c", 1, 2), ("F3", "e", 1, 1), ("F4", "c", 1, 1), ("F4", "f", 1, 1), ("F5", "a", 1, 1), ("F5", "f", 1, 1)], "family string, id string, start_line int, end_line int")
    told = lambda **k: {tuple(r) for r in clones.suppress(members, docs, **k).collect()}
    assert told() == {("F1", "boilerplate")}
    assert told(include_boilerplate=True, include_declarative=False) == {("F2", "declarative")}
