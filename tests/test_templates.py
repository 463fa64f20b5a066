"""Rules whose targets are made of captures."""

import pytest

from evidentia.operators import joins, templates

RULE = "rule string, from_path string, from_not string, to_path string, to_not string, kinds array<string>, severity string"


def found(spark, edges, rules):
    e = spark.createDataFrame(edges, "from_path string, to_path string, kind string")
    r = spark.createDataFrame([(f"r{k}", *x, ["any"], "error") for k, x in enumerate(rules)], RULE)
    return {(x["rule"], x["from_path"], x["to_path"]) for x in templates.template_violations(e, r).collect()}


def test_captures_are_literal(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT", 2)
    monkeypatch.setattr(joins, "HOT_KEYS", 1)
    edges = [("src/a.b/x.ts", "src/a.b/y.ts", "k"), ("src/a.b/x.ts", "src/aXb/y.ts", "k"), ("src/a$2/x.ts", "src/a$2/z.ts", "k"), ("src/a+(/x.ts", "src/a+(/y.ts", "k"), ("lib/é/x.ts", "lib/é/y.ts", "k"), ("src/q.ts", "src/none.ts", "k"), (None, "src/a.b/y.ts", "k"), ("src/q.ts", None, "k")]
    assert found(spark, edges, [("^src/([^/]+)/(x)", None, "^src/$1/[yz]", None)]) == {("r0", "src/a.b/x.ts", "src/a.b/y.ts"), ("r0", "src/a$2/x.ts", "src/a$2/z.ts"), ("r0", "src/a+(/x.ts", "src/a+(/y.ts")}
    assert found(spark, edges, [("([^/]+)/x", None, "/$1/y", None), ("^(src|lib)/", "a", None, None)]) == {("r0", "src/a.b/x.ts", "src/a.b/y.ts"), ("r0", "src/a+(/x.ts", "src/a+(/y.ts"), ("r0", "lib/é/x.ts", "lib/é/y.ts"), ("r1", "lib/é/x.ts", "lib/é/y.ts"), ("r1", "src/q.ts", "src/none.ts")}
    # An absent optional group is empty; a target that is spared.
    assert found(spark, edges, [("^src/(nope)?q", None, "^src/$1none", None), ("^src/", None, "^src/", "a")]) == {("r0", "src/q.ts", "src/none.ts"), ("r1", "src/q.ts", "src/none.ts")}
    assert found(spark, [], [("^src/", None, None, None)]) == set()


def test_bad_rules_are_refused(spark):
    for bad in (("^src/(a)", None, "$2", None), ("^src/(", None, None, None), ("^src/(a)", None, "($1", None)):
        with pytest.raises(Exception):
            found(spark, [("a", "b", "k")], [bad])


def test_unresolved(spark):
    imports = spark.createDataFrame([("a/x", "lost"), ("a/x", "lost"), ("b/y", "lost"), ("c/z", "lost")], "path string, target string")
    assigned = spark.createDataFrame([("a/x", "A"), ("b/y", "B"), ("c/z", None)], "path string, component string")
    rules = spark.createDataFrame([("u", "forbid", ["A", "C"], ["unresolved", "x"], "warn"), ("v", "forbid", ["B"], ["any"], "warn"), ("w", "require", ["B"], ["unresolved"], "warn")], "rule string, action string, sources array<string>, kinds array<string>, severity string")
    assert [(r["rule"], r["path"], r["target"]) for r in templates.unresolved_violations(imports, assigned, rules).collect()] == [("u", "a/x", "lost")]
