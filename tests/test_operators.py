"""Operators on small literal inputs, and functions case by case."""

import pytest
from pyspark.sql import functions as F

from evidentia.functions import paths, text
from evidentia.operators import change, contracts, flow, graph, links, nearest, measure, policy, source
from evidentia.streaming import projections

EDGE = "src string, dst string, kind string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def edges(spark, *pairs, kind="calls"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], EDGE)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_walk_stops(spark):
    e = edges(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("c", "hub:1"), ("hub:1", "z"))
    nodes, walked, frontier, stop = flow.walk(e, ids(spark, "a"), 9, 100, hubs=("hub",))
    assert rows(nodes) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3), ("hub:1", 2)] and stop == "COMPLETE" and frontier.isEmpty()
    assert len(rows(walked)) == 6
    nodes, walked, frontier, stop = flow.walk(e, ids(spark, "a"), 9, 3, hubs=("hub",))
    assert rows(nodes) == [("a", 0), ("b", 1), ("c", 1)] and stop == "MAX_NODES"
    assert rows(frontier) == [("b", "d", "calls"), ("c", "d", "calls"), ("c", "hub:1", "calls")]
    assert flow.walk(e, ids(spark, "a"), 2, 100)[3] == "MAX_DEPTH"
    assert rows(flow.walk(e, ids(spark, "e"), 2, 100, direction="backward")[0]) == [("b", 2), ("c", 2), ("d", 1), ("e", 0)]
    assert rows(flow.walk(e, ids(spark, "hub:1"), 1, 100, hubs=("hub",))[0]) == [("hub:1", 0), ("z", 1)]


def test_cycles_and_generations(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "y"))
    c = flow.strong_components(e).cache()
    assert rows(c.select("id", "component")) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("x", "x"), ("y", "y")]
    q = flow.condensation(e, c.select("id", "component"))
    assert rows(q) == [("a", "d"), ("x", "y")]
    assert rows(flow.generations(c.select(F.col("component").alias("id")).distinct(), q)) == [("a", 0), ("d", 1), ("x", 0), ("y", 1)]
    with pytest.raises(ValueError):
        flow.generations(ids(spark, "a", "b"), edges(spark, ("a", "b"), ("b", "a")))
    assert flow.strong_components(e.limit(0)).count() == 0


def test_communities(spark):
    files = ["left/a", "left/b", "left/c", "right/x", "right/y", "other/o"]
    f = spark.createDataFrame([(x,) for x in files], "path string")
    own = f.select(F.col("path").alias("id"), F.col("path").alias("file"))
    e = edges(spark, ("left/a", "left/b"), ("left/b", "left/c"), ("right/x", "right/y"), ("left/c", "right/x"))
    pairs = flow.file_pairs(e, own)
    two = flow.subsystems(f, pairs, 2, 5)
    assert rows(two) == [(x, x.split("/")[0], "subsystem") for x in files[:5]]
    assert rows(flow.boundaries(pairs, two)) == [("left/c", "right/x", "left", "right", "calls", "weak_bridge")]
    assert {r[1] for r in rows(flow.subsystems(f, pairs, 1, 5))} == {"left"}
    hub = flow.subsystems(f, pairs, 1, 2)
    assert ("left/c", "left/c", "utility") in rows(hub)
    assert any(r[-1] == "utility_hub" for r in rows(flow.boundaries(pairs, hub)))


def test_shortest_path(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("a", "x"), ("x", "c"), ("c", "d"), ("a", "q")).withColumn("evidence", F.lit("parsed"))
    assert [(r["hop"], r["src"], r["dst"]) for r in graph.shortest_path(e, "a", "c").orderBy("hop", "src", "dst").collect()] == [(1, "a", "b"), (1, "a", "x"), (2, "b", "c"), (2, "x", "c")]
    assert graph.shortest_path(e, "d", "a").count() == 0


def test_change(spark):
    d = "id string, label string, kind string, path string, print string"
    before = spark.createDataFrame([("1", "f", "fn", "p", "x"), ("2", "g", "fn", "p", "y"), ("3", "h", "fn", "p", "z"), ("4", "twin", "fn", "p", "t"), ("5", "twin", "fn", "p", "t")], d)
    after = spark.createDataFrame([("1", "f2", "fn", "p", "x"), ("2b", "g", "fn", "p", "y2"), ("3b", "k", "fn", "q", "z"), ("6", "twin", "fn", "p", "t"), ("7", "twin", "fn", "p", "t")], d)
    pairs = change.pair_declarations(before, after)
    assert {(r["before_id"], r["after_id"], r["stage"]) for r in pairs.collect()} == {("1", "1", "id"), ("2", "2b", "declaration"), ("3", "3b", "print"), ("4", None, "none"), ("5", None, "none"), (None, "6", "none"), (None, "7", "none")}
    assert {(r["before_id"], r["change"]) for r in change.classify_pairs(pairs, before, after).collect() if r["before_id"]} == {("1", "signature"), ("2", "body"), ("3", "signature"), ("4", "removed"), ("5", "removed")}
    e = edges(spark, ("t", "a"), ("u", "t"), ("t", "b"), ("v", "u"))
    assert rows(change.impact(e, ids(spark, "a", "b"), 2)) == [("a", "t", 1, "calls", "a"), ("a", "u", 2, "calls", "t"), ("b", "t", 1, "calls", "b"), ("b", "u", 2, "calls", "t")]
    assert change.impact(e, ids(spark, "v"), 2).count() == 0
    found = lambda *x: spark.createDataFrame([(i,) for i in x], "finding string")
    assert rows(change.partition_findings(found("a", "b", "b"), found("b", "c"))) == [("a", "new"), ("b", "existing"), ("c", "fixed")]
    n = spark.createDataFrame([("x", 2), ("x", 1), ("y", 1), ("x", 3)], "k string, o int")
    assert rows(change.numbered(n, "k", ["o"])) == [("x", 1), ("x~2", 2), ("x~3", 3), ("y", 1)]


def test_measure(spark):
    p = spark.createDataFrame([("m", 1, "r1", 0.0), ("m", 2, "r2", 10.0), ("m", 3, "r2", 11.0), ("m", 4, "r3", 5.5)], "series string, row int, revision string, value double")
    s = measure.steps(p, "series", "row", 10.0).cache()
    assert [tuple(r) for r in s.select("row", "kind", "delta", "percent", "verdict").orderBy("row").collect()] == [(2, "compared", 10.0, None, "regressed"), (3, "same_revision", 1.0, 10.0, "flat"), (4, "compared", -5.5, -50.0, "improved")]
    assert rows(measure.noise_floor(s, "series")) == [("m", 1, 10.0)]
    c = spark.createDataFrame([(2, "f"), (4, "f"), (4, "g")], "row int, symbol string")
    assert {r["symbol"]: (r["steps"], r["delta_sum"], r["weighted_delta"], r["evidence"]) for r in measure.credit(s, c, ["row"]).collect()} == {"f": (2, 4.5, 7.25, "isolated"), "g": (1, -5.5, -2.75, "co_changed")}
    assert rows(measure.last_points(p, "series", "row", 2).select("row")) == [(3,), (4,)]


@pytest.mark.parametrize("key, binding, fits", [
    ("a.b", "a.b", True), ("a.b", "a.*", True), ("a.b.c", "a.*", False), ("a", "a.*", False), ("a.b.c", "a.#", True), ("a", "a.#", True), ("a.b", "#", True), ("a.b", "*.*", True), ("a.b", "b.#", False), ("a", "a.b.#", False), (None, "#", False),
])
def test_routes(spark, key, binding, fits):
    df = spark.createDataFrame([(key, binding)], "k string, b string")
    assert df.select(contracts.routes(F.col("k"), F.col("b"))).first()[0] is fits


def test_contracts(spark):
    old = spark.createDataFrame([("a", "int", True), ("b", "int", False), ("c", "int", True), ("d", "int", False)], "member string, type string, required boolean")
    new = spark.createDataFrame([("a", "int", True), ("b", "long", False), ("d", "int", True), ("e", "int", True), ("f", "int", False)], "member string, type string, required boolean")
    assert rows(contracts.schema_states(old, new)) == [("a", "kept"), ("b", "retyped"), ("c", "removed"), ("d", "now_required"), ("e", "added_required"), ("f", "added")]
    o = spark.createDataFrame([("q", "producer", "kafka", "topic"), ("q", "consumer", "amqp", "queue"), ("r", "producer", "jms", "destination"), ("r", "consumer", "jms", "queue")], "resource string, role string, family string, entity string")
    assert rows(contracts.kind_mismatches(o)) == [("TRANSPORT_MISMATCH", "q", "kafka:topic", "amqp:queue")]


CASES = {
    "src/a.ts": "product", "Tests/a.py": "test", "src/a.test.js": "test", "src/a_test.go": "test", "src/latest/a.py": "product", ".vscode/x.json": "classified", "tsconfig.build.json": "classified", "tsconfig.json": "classified",
    "a/vite.config.ts": "classified", ".github/workflows/x.yml": "classified", "x/.github/y": "product", "deploy/a.py": "classified", "package.json": "classified", "docs/a.py": "classified", "my-bench/a.py": "classified",
    "src/tests.rs": "classified", "README.md": "classified", "a.min.js": "classified", "a\\mocks\\b.ts": "classified",
}


def test_path_classes(spark):
    df = spark.createDataFrame([(p,) for p in CASES], "p string")
    assert {r[0]: r[1] for r in df.select("p", paths.path_class(F.col("p"))).collect()} == CASES
    suites = {"a/b.spec.ts": True, "a/__tests__/b.js": True, "tests/x.rs": True, "a_test.go": True, "test_a.py": True, "a.py": False, "src/b.ts": False}
    df = spark.createDataFrame([(p,) for p in suites], "p string")
    assert {r[0]: r[1] for r in df.select("p", paths.is_test_suite(F.col("p"))).collect()} == suites
    stems = {"s/init.test.js": "init", "test_init.py": "init", "init_test.go": "init", "a/__tests__/Init.js": "init", "init.py": None}
    df = spark.createDataFrame([(p,) for p in stems], "p string")
    assert {r[0]: r[1] for r in df.select("p", paths.covered_stem(F.col("p"))).collect()} == stems
    with pytest.raises(ValueError):
        paths.in_scope(F.lit("a"), "../a")


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.name_parts(F.lit("getHTTPBody_v2"))) == ["get", "h", "t", "t", "p", "body", "v2"]
    assert text.question_tokens("Where is the parseFile_fn call?") == ["file", "fn", "parse", "parsefile_fn"]
    assert one(text.redacted(F.lit("apiToken"), F.lit("x"))) == "[redacted]" and one(text.redacted(F.lit("url"), F.lit("https://u:p@h"))) == "[redacted]" and one(text.redacted(F.lit("url"), F.lit("https://h"))) == "https://h"
    assert one(text.token_estimate(F.lit("áb"))) == 1 and one(text.percent_change(F.lit(0.0), F.lit(1.0))) is None


def test_policy(spark):
    nodes = spark.createDataFrame([("a", "ui/x"), ("b", "core/y"), ("c", "core/db/z"), ("d", "lib/q")], "id string, path string")
    comp = spark.createDataFrame([("ui", "ui"), ("core", "core"), ("db", "core/db")], "component string, prefix string")
    rules = spark.createDataFrame([("r1", "forbid", "direct", ["ui"], ["db"], ["any"], "error"), ("r2", "allow_only", "direct", ["core"], ["db"], ["calls"], "warn"), ("r3", "forbid", "transitive", ["ui"], ["db"], ["calls"], "error"), ("r4", "require", "direct", ["ui"], ["db"], ["calls"], "error")],
                                  "rule string, action string, reachability string, sources array<string>, targets array<string>, kinds array<string>, severity string")
    e = edges(spark, ("a", "b"), ("b", "c"), ("b", "d"))
    at = policy.assign_components(nodes, comp).cache()
    assert rows(at.where("component is not null").select("id", "component")) == [("a", "ui"), ("b", "core"), ("c", "db")]
    direct = policy.direct_violations(policy.joined_edges(e, at), rules).cache()
    assert rows(direct.select("rule", "src", "dst")) == [("r2", "b", "d")]
    assert rows(policy.path_violations(e, at, rules).select("rule", "source_path", F.coalesce("hops", F.lit(-1)))) == [("r3", "ui/x", 2), ("r4", "ui/x", -1)]
    f = lambda *x: spark.createDataFrame([(i,) for i in x], "fingerprint string")
    print_ = direct.first()["fingerprint"]
    assert rows(policy.ratchet(direct, f("gone"), f("none")).select("status")) == [("fixed",), ("warning",)]
    assert rows(policy.ratchet(direct, f(print_), f("none")).select("status")) == [("existing",)]
    assert rows(policy.ratchet(direct, f(print_), f(print_)).select("status")) == [("excepted",)]


def test_source(spark):
    docs = spark.createDataFrame([(1, "a\nhit\nb\nhit 2\nc"), (2, "none"), (3, None)], "id long, text string")
    assert rows(source.matching_lines(docs, lambda x: x.startswith("hit"), 1, 1, 1)) == [(1, 2, 2, "a\nhit\nb")]
    turns = spark.createDataFrame([(1, t, 10) for t in range(300)] + [(2, 0, 99)], "g long, t long, n long")
    got = source.fit_budget(turns, "g", "t", "n", 55)
    assert rows(got.select("g", "t", "used")) == [(1, 295, 50), (1, 296, 40), (1, 297, 30), (1, 298, 20), (1, 299, 10)]
    files = spark.createDataFrame([("a/b/c.ts",), ("x/c.ts",), ("y/d.ts",)], "path string")
    fr = spark.createDataFrame([("C:\\w\\a\\b\\c.ts",), ("q/c.ts",), ("./y/d.ts",), ("zz",)], "frame string")
    assert rows(source.match_frames(files, fr).select("frame", "matched", "overlap")) == [("./y/d.ts", "one", 2), ("C:\\w\\a\\b\\c.ts", "one", 3), ("q/c.ts", "many", 1), ("zz", "none", 0)]


def test_links_of_bad_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [0.0, 1.0])], "id long, v array<double>")
    assert [(r["query_id"], r["id"]) for r in nearest.top_k(v, v.select("id"), 1).orderBy("query_id").collect()] == [(0, 1), (1, 0), (5, 1)]
    assert rows(links.links(v, v.select("id"), 1, 0.5, "mutual").select("a", "b")) == [(0, 1), (1, 0)]
    assert nearest.top_k(v.limit(0), v.select("id"), 1).count() == 0


def test_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k * 10 + i, i % 2, f"2024-01-0{k + 1} 0{i}:10:00") for i in range(5)], "e long, u long, t string").selectExpr("e", "u", "cast(t as timestamp) as ts").write.parquet(f"{tmp_path}/f{k}")
    e = projections.event_stream(spark, f"{tmp_path}/f*", 1)
    latest = projections.run_available(spark, projections.latest_by_key(e, ["u"], "ts", "e", []), "complete")
    assert rows(latest) == [(0, 24), (1, 23)]
    counts = projections.run_available(spark, projections.hourly_counts(projections.event_stream(spark, f"{tmp_path}/f*"), "ts", "u", "1 hour"), "append")
    assert counts.count() >= 10 and {r["n"] for r in counts.collect()} == {1}


def test_diff_with_null_evidence(spark):
    cols = "src string, dst string, kind string, evidence string"
    before = spark.createDataFrame([("a", "b", "k", None), ("a", "c", "k", "x"), ("a", "d", "k", None), ("a", "e", "k", "x")], cols)
    after = spark.createDataFrame([("a", "b", "k", None), ("a", "c", "k", None), ("a", "d", "k", "y"), ("a", "f", "k", None)], cols)
    assert rows(graph.diff_edges(before, after)) == [("a", "c", "k", "changed"), ("a", "d", "k", "changed"), ("a", "e", "k", "removed"), ("a", "f", "k", "added")]


def test_routes_with_signs(spark):
    routes = [("/a+b/c", "GET"), ("/files/*", "GET"), ("/v[1]/{id}.json", "GET"), ("/u/:id/x", "PUT"), ("/{any}/x", "GET"), ("/", "GET"), ("/x.y", "GET")]
    calls = [(1, "/a+b/c", "GET"), (2, "/aab/c", "GET"), (3, "/files/a", "GET"), (4, "/files/a/b", "GET"), (5, "/v[1]/7.json", "GET"), (6, "/v1/7.json", "GET"), (7, "/u/9/x/", "GET"), (8, "/q/x", "GET"), (9, "/", "GET"), (10, "/xzy", "GET"), (11, "/x.y", "POST")]
    got = contracts.http_matches(spark.createDataFrame(routes, "route string, method string"), spark.createDataFrame(calls, "call int, path string, method string"))
    assert {r["call"]: (r["route"], r["state"]) for r in got.collect()} == {
        1: ("/a+b/c", "matched"), 2: (None, "MISSING_ENDPOINT"), 3: ("/files/*", "matched"), 4: (None, "MISSING_ENDPOINT"), 5: ("/v[1]/{id}.json", "matched"), 6: (None, "MISSING_ENDPOINT"),
        7: ("/u/:id/x", "METHOD_MISMATCH"), 8: ("/{any}/x", "matched"), 9: ("/", "matched"), 10: (None, "MISSING_ENDPOINT"), 11: ("/x.y", "METHOD_MISMATCH"),
    }


@pytest.mark.parametrize("key,binding,fits", [("a.x.y", "a.#.b", False), ("a.b", "a.#.b", True), ("a.x.y.b", "a.#.b", True), ("x.y", "#.b", False), ("x.b", "#.b", True), ("b", "#.b", True), ("a.b.c", "#.b.#", True), ("a+b", "a+b", True), ("aab", "a+b", False), ("a.", "a.*", True)])
def test_hash_within_a_binding(spark, key, binding, fits):
    df = spark.createDataFrame([(key, binding)], "k string, b string")
    assert df.select(contracts.routes(F.col("k"), F.col("b"))).first()[0] is fits


def test_no_hop_is_too_far(spark):
    n = 30
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "k") for i in range(n)], "src string, dst string, kind string")
    nodes = spark.createDataFrame([(f"n{i}", "function", False) for i in range(n + 1)], "id string, kind string, exported boolean")
    assert flow.unreferenced(nodes, edges.withColumn("kind", F.lit("contains")), spark.createDataFrame([("n0",)], "id string"), ("contains",)).count() == 0
    assigned = spark.createDataFrame([(f"n{i}", f"p{i}", "a" if i == 0 else "b" if i == n else None) for i in range(n + 1)], "id string, path string, component string")
    r = spark.createDataFrame([("far", "forbid", "transitive", ["a"], ["b"], ["any"], "error"), ("need", "require", "transitive", ["a"], ["b"], ["k"], "error"), ("other", "require", "transitive", ["a"], ["b"], ["z"], "error")], "rule string, action string, reachability string, sources array<string>, targets array<string>, kinds array<string>, severity string")
    found = lambda **k: {(x["rule"], x["hops"]) for x in policy.path_violations(edges, assigned, r, **k).collect()}
    assert found() == {("far", n), ("other", None)} and found(max_hops=8) == {("need", None), ("other", None)}
