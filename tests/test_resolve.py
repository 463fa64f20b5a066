"""Import candidates, closures and the reference ladder on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import joins, resolve


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_candidates(spark):
    d = spark.createDataFrame([("src/a/./b/../c",), ("../x",), ("a/user.model",), ("a/b.ts",), ("a/b.js",)], "p string")
    d = d.select(resolve.normalised(F.col("p")).alias("b"))
    assert [r[0] for r in d.collect()] == ["src/a/c", "x", "a/user.model", "a/b.ts", "a/b.js"]
    got = [r[0] for r in d.select(resolve.candidates(F.col("b"), ["ts", "js"], True)).collect()]
    assert got[0][:3] == ["src/a/c", "src/a/c.ts", "src/a/c/mod.ts"] and len(got[2]) == 9 and got[3] == ["a/b.ts"] and got[4] == ["a/b.js", "a/b.ts", "a/b.tsx", "a/b.mts", "a/b.cts"]


def test_first_existing(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT", 1)
    monkeypatch.setattr(joins, "HOT_KEYS", 2)
    files = spark.createDataFrame([("a/B.js",), ("a/c.js",), ("a/C.js",), ("x/i.js",), ("x/i.js",), (None,)], "path string")
    wanted = spark.createDataFrame([(1, ["a/b", "a/b.js"]), (2, ["a/d.js", "a/C.js"]), (3, ["A/c.js", "x/I.js"]), (4, ["no"]), (5, ["x/i.js", "a/c.js"]), (6, []), (7, None), (8, ["x/i.js"]), (9, ["x/i.js"])], "key int, candidates array<string>")
    assert pairs(resolve.first_existing(wanted, files)) == {(2, "a/C.js", 1), (5, "x/i.js", 0), (8, "x/i.js", 0), (9, "x/i.js", 0)}
    # c.js and C.js are equal but for case, so folding tells nothing there.
    assert pairs(resolve.first_existing(wanted, files, F.lit(True))) == {(1, "a/B.js", 1), (2, "a/C.js", 1), (3, "x/i.js", 1), (5, "x/i.js", 0), (8, "x/i.js", 0), (9, "x/i.js", 0)}


def test_packages(spark):
    files = spark.createDataFrame([("pkg/a/x.go",), ("pkg/a/y.go",), ("pkg/a/sub/z.go",), ("pkg/a/x.ts",), ("m/src/main/java/com/acme/T.java",), ("q/src/com/acme.java",), ("other/com/acme/T.java",)], "path string")
    go = spark.createDataFrame([(1, "h.org/repo/pkg/a"), (2, "h.org/else/pkg/a"), (3, "h.org/repo"), (4, "repo/pkg/a/sub")], "key int, target string")
    assert pairs(resolve.package_files(go, files, "repo")) == {(1, "pkg/a/x.go"), (1, "pkg/a/y.go"), (4, "pkg/a/sub/z.go")}
    java = spark.createDataFrame([(1, "com.acme.T"), (2, "com.acme.T.Inner"), (3, "com.acme.*"), (4, "org.x"), (5, "*")], "key int, target string")
    assert pairs(resolve.longest_suffix(java, files)) == {(1, "m/src/main/java/com/acme/T.java"), (2, "m/src/main/java/com/acme/T.java"), (3, "q/src/com/acme.java")}


def closure(entry, forwards, depth, most):
    seen, front, out = {entry}, [entry], []
    for _ in range(depth):
        new = []
        for x in front:
            for _, y in sorted(forwards.get(x, [])):
                if y not in seen:
                    seen.add(y)
                    out.append(y)
                    new.append(y)
        if not new or len(out) >= most:
            break
        front = new
    return out[:most]


def test_closure(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(9), rng.randrange(60)) for _ in range(130)]
    edges = [(a, p, b) for a, p, b in {(a, b): (a, p, b) for a, p, b in edges}.values()] + [(70, 0, 71), (71, 0, 70), (80, 0, 80)]
    by = {}
    for a, p, b in edges:
        by.setdefault(a, []).append((p, b))
    f = spark.createDataFrame(edges, "path int, pos int, to int")
    entries = spark.createDataFrame([(i, i) for i in range(90)], "key int, path int")
    for depth, most in ((4, 16), (2, 3), (9, 200)):
        got = {}
        for r in resolve.forwarded(entries, f, depth, most).orderBy("key", "place").collect():
            got.setdefault(r["key"], []).append(r["path"])
        assert got == {i: c for i in range(90) if (c := closure(i, by, depth, most))}


def test_ladder(spark):
    symbols = spark.createDataFrame([("own", "a.py", "f", "function", "python"), ("x1", "b.py", "g", "function", "python"), ("x2", "b.py", "g", "constant", "python"), ("y", "c.py", "h", "constant", "python"), ("z", "d.py", "only", "function", "python"), ("t", "d.ts", "lines", "constant", "typescript"), ("m1", "r.rs", "step", "method", "rust"), ("m2", "r.rs", "step", "function", "rust")], "id string, path string, name string, kind string, language string")
    bindings = spark.createDataFrame([("a.py", "local", "b.py", "g", False), ("a.py", "local", "c.py", "h", True), ("a.py", "far", "c.py", "h", True), ("a.py", "two", "b.py", "g", False), ("a.py", "two", "c.py", "h", False)], "path string, local string, target_path string, imported string, forwarded boolean")
    imported = spark.createDataFrame([("a.py", "b.py"), ("a.py", "c.py"), ("a.py", "c.py"), ("e.ts", "d.ts")], "path string, target_path string")
    refs = [("own", "a.py", "f", "python", "references", "src"), ("itself", "a.py", "f", "python", "references", "own"), ("recursion", "a.py", "f", "python", "calls", "own"), ("direct", "a.py", "local", "python", "calls", "src"), ("not callable", "a.py", "local", "python", "references", "src"), ("far", "a.py", "far", "python", "references", "src"), ("two", "a.py", "two", "python", "calls", "src"), ("file", "a.py", "h", "python", "references", "src"), ("repo", "a.py", "only", "python", "calls", "src"), ("none", "a.py", "nothing", "python", "calls", "src"), ("null", "a.py", None, "python", "calls", None), ("script", "f.ts", "lines", "typescript", "references", "src"), ("script import", "e.ts", "lines", "typescript", "references", "src")]
    rows = [(*r, False, None) for r in refs] + [("member", "e.ts", "lines", "typescript", "calls", "s", True, "x"), ("self", "r.rs", "step", "rust", "calls", "s", True, "self"), ("value", "r.rs", "step", "rust", "calls", "s", True, "values"), ("free", "r.rs", "step", "rust", "references", "s", None, None)]
    r = spark.createDataFrame(rows, "ref string, path string, name string, language string, kind string, source string, qualified boolean, receiver string")
    assert {r["ref"]: (r["target"], r["stage"]) for r in resolve.resolve_references(r, symbols, bindings, imported).collect()} == {
        "own": ("own", "own_file"), "itself": (None, "unresolved"), "recursion": ("own", "own_file"), "direct": ("x1", "import_binding"), "not callable": ("y", "import_binding"), "far": ("y", "import_binding"), "two": (None, "unresolved"), "file": ("y", "imported_file"),
        "repo": ("z", "repository"), "none": (None, "unresolved"), "null": (None, "unresolved"), "script": (None, "unresolved"), "script import": ("t", "imported_file"), "member": (None, "refused"), "self": ("m1", "self_method"), "value": (None, "refused"), "free": (None, "unresolved"),
    }


def told(ref, symbols, bindings, imported):
    """target, stage of one reference, from the stages' own words."""
    _, path, name, language, kind, source, qualified, receiver = ref
    calls = kind == "calls"

    def means(p, n):
        here = [s for s in symbols if s[1] == p and s[2] == n and p is not None and n is not None]
        if calls and len(here) != 1:
            here = [s for s in here if s[3] in resolve.CALLABLE]
        return here[0][0] if len(here) == 1 else None

    if qualified and language in ("typescript", "rust"):
        methods = [s[0] for s in symbols if s[1] == path and s[2] == name and s[3] == "method"]
        return (methods[0], "self_method") if language == "rust" and receiver == "self" and len(methods) == 1 else (None, "refused")
    own = means(path, name)
    if own is not None and (calls or own != source):
        return own, "own_file"
    for forwarded in (False, True):
        to = {means(b[2], b[3]) for b in bindings if b[0] == path and b[1] == name and b[4] == forwarded and path is not None} - {None, source}
        if len(to) == 1:
            return to.pop(), "import_binding"
        if to:
            break
    to = {means(b[1], name) for b in imported if b[0] == path and path is not None} - {None, source}
    if len(to) == 1:
        return to.pop(), "imported_file"
    to = [s[0] for s in symbols if s[4] == language and s[2] == name and language != "typescript" and (calls or s[0] != source)]
    return (to[0], "repository") if len(to) == 1 else (None, "unresolved")


REFS = "ref long, path string, name string, language string, kind string, source string, qualified boolean, receiver string"


@pytest.mark.parametrize("most, listed", [(256, 500_000), (2, 500_000), (0, 500_000), (256, 0)])
def test_ladder_is_its_stages(spark, monkeypatch, most, listed):
    """Names that few or many files define, files that import few or many, with repeats and nulls, against brute force."""
    monkeypatch.setattr(resolve, "LIST", most)
    monkeypatch.setattr(resolve, "LISTED", listed)
    rng = random.Random(11)
    pick = rng.choice
    paths, languages = [f"d/{k}" for k in range(7)], ["python", "rust", "typescript"]
    names = lambda: f"n{int(rng.random() ** 2 * 14)}"
    symbols = [(f"s{k}", pick(paths), names(), pick(["function", "method", "constant"]), pick(languages)) for k in range(45)]
    bindings = [(pick(paths), names(), pick(paths), names(), rng.random() < 0.4) for _ in range(260)] + [(None, "n1", "d/1", "n1", False), ("d/1", "n1", None, "n1", False), ("d/1", "n1", "d/2", None, True)]
    bindings += bindings[:90]
    imported = [(pick(paths), pick(paths)) for _ in range(12)] + [(None, "d/1"), ("d/1", None)]
    refs = [(k, pick(paths + [None]), pick([names(), names(), names(), None]), pick(languages), pick(["calls", "references"]), pick([f"s{rng.randrange(45)}", "x", None]), rng.random() < 0.2, pick(["self", "x", None])) for k in range(1500)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = resolve.resolve_references(
        df(refs, REFS), df(symbols, "id string, path string, name string, kind string, language string"), df(bindings, "path string, local string, target_path string, imported string, forwarded boolean"), df(imported, "path string, target_path string")
    ).collect()
    want = {r[0]: told(r, symbols, bindings, imported) for r in refs}
    assert len(got) == len(want) and {r["ref"]: (r["target"], r["stage"]) for r in got} == want
    assert {s for _, s in want.values()} == {"own_file", "import_binding", "imported_file", "repository", "self_method", "refused", "unresolved"}


def test_ladder_writes_no_references(spark, monkeypatch):
    """What is written grows with symbols, bindings and imports, not with references."""
    tables, cut_table = [], resolve.cut_table
    monkeypatch.setattr(resolve, "cut_table", lambda d: tables.append(cut_table(d)) or tables[-1])
    n = 2_000
    refs = spark.range(n).selectExpr("id AS ref", "concat('p', id % 5) AS path", "concat('n', id % 700) AS name", "'python' AS language", "'calls' AS kind", "'x' AS source", "false AS qualified", "CAST(null AS string) AS receiver")
    symbols = spark.range(20).selectExpr("concat('s', id) AS id", "concat('p', id % 4) AS path", "concat('n', id) AS name", "'function' AS kind", "'python' AS language")
    bindings = spark.range(n).selectExpr("'p4' AS path", "'n30' AS local", "'p1' AS target_path", "concat('n', id % 30) AS imported", "false AS forwarded")
    imported = spark.createDataFrame([("p0", "p1"), ("p0", "p2")], "path string, target_path string")
    stages = {r["stage"]: r["count"] for r in resolve.resolve_references(refs, symbols, bindings, imported).groupBy("stage").count().collect()}
    assert sum(stages.values()) == n and set(stages) == {"own_file", "imported_file", "repository", "unresolved"}
    assert max(t.count() for t in tables) <= 30
