"""Index searches against a scan."""

import re

import pandas as pd
import pytest

from evidentia.operators import textindex

DOCS = [(i, f"src/{'ab'[i % 2]}/f{i:03d}.py", "\n".join([f"line {i} alpha", "Größe naïve" if i % 7 == 0 else "plain", f"x = foo({i}) + bar{i % 10}"] * (i % 3 + 1))) for i in range(120)] + [(500, "doc/n.md", None), (501, "doc/e.md", "")]


def scan(fits, paths=lambda p: True):
    return sorted((p, i, n) for i, p, t in DOCS if paths(p) for n, x in enumerate((t or "").split("\n"), 1) if fits(x))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    textindex.SHARD, before = 10, textindex.SHARD
    made = textindex.build(spark.createDataFrame(DOCS, "id long, path string, text string"), str(tmp_path_factory.mktemp("index") / "i"))
    textindex.SHARD = before
    return made


@pytest.mark.parametrize("query,regex", [("foo(7)", False), ("bar3", False), ("Größe", False), ("zzz none", False), ("al", False), ("", False), (r"foo\(1[0-9]\) \+ bar[13]", True), (r"(alpha)$", True), (r"x|plain", True), (r"(?i)ALPHA", True), (r"na.ve", True), (r"bar9+", True)])
def test_equal_to_a_scan(index, query, regex):
    want = scan((lambda x: re.search(query, x)) if regex else (lambda x: query in x))
    got = textindex.search(index, query, regex, most=10_000).collect()
    assert sorted((r["path"], r["id"], r["line_no"]) for r in got) == want
    assert all((r["matching_lines"], r["files"], r["truncated"]) == (len(want), len({w[1] for w in want}), False) for r in got)


def test_reads_a_small_share(index):
    assert index.shards == 12 and {r["id"] for r in textindex.candidates(index, "foo(77)").collect()} == {77}
    assert textindex.candidates(index, "zzz none").count() == 0 and textindex.candidates(index, "fo") is None
    # Of the common grams only the rare ones are read.
    assert textindex.candidates(index, "x = foo(5) + bar5").count() < 20


def test_pages_globs_and_budget(index):
    want = scan(lambda x: "alpha" in x, lambda p: p.startswith("src/a/"))
    got = textindex.search(index, "alpha", globs=["src/**", "!src/b/*"], after=1, most=5).orderBy("path", "line_no").collect()
    assert [(r["path"], r["id"], r["line_no"]) for r in got] == want[:5] and got[0]["truncated"] and got[0]["matching_lines"] == len(want) and "\n" in got[0]["context"]
    small = textindex.search(index, "alpha", most=40, budget=20).collect()
    assert sum(len(r["context"].encode()) for r in small) <= 80 and 0 < len(small) < 40 and small[0]["truncated"]


def test_grams_leave_a_task_in_lots():
    """Not one small table for each document."""
    n = textindex.LOT + 10
    out = list(textindex._grams([pd.DataFrame({"id": range(n), "text": ["abcd"] * (n - 1) + [""]})]))
    assert len(out) == 2 and sum(map(len, out)) == 2 * (n - 1)
    assert set(zip(out[1]["id"], out[1]["gram"])) == {(i, g) for i in range(textindex.LOT, n - 1) for g in (0x616263, 0x626364)}
