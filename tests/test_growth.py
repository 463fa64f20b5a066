"""Work that grows with the input: rows that Spark makes on the way, as its own metrics give them."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import change, flow, graph, joins, policy, resolve, spans, strong
from evidentia.plans import graphs, resolve_queries, table_queries


def most_rows(spark, since, name="number of output rows"):
    """The most rows that one operator put out (or name says) in the executions numbered after since."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for i in range(runs.length()):
        run = runs.apply(i).executionId()
        if run <= since:
            continue
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for j in range(nodes.length()):
            metrics = nodes.apply(j).metrics()
            for k in range(metrics.length()):
                m = metrics.apply(k)
                value = values.get(m.accumulatorId())
                if m.name() == name and value.isDefined():
                    most = max(most, int(value.get().replace(",", "")))
    return most


def last_run(spark):
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return max((runs.apply(i).executionId() for i in range(runs.length())), default=-1)


def test_ladder_settles_a_bound_name_once(spark):
    """Many references to a name that its file binds to many others: not each with each."""
    n = 600
    refs = spark.range(n).selectExpr("id AS ref", "'a' AS path", "'f' AS name", "'python' AS language", "'calls' AS kind", "concat('s', id) AS source", "false AS qualified", "CAST(null AS string) AS receiver")
    symbols = spark.range(n).selectExpr("concat('s', id) AS id", "concat('b', id) AS path", "'g' AS name", "'function' AS kind", "'python' AS language")
    bindings = spark.range(n).selectExpr("'a' AS path", "'f' AS local", "concat('b', id) AS target_path", "'g' AS imported", "id > 1 AS forwarded")
    imported = spark.createDataFrame([], "path string, target_path string")
    since = last_run(spark)
    got = {r["ref"]: (r["target"], r["stage"]) for r in resolve.resolve_references(refs, symbols, bindings, imported).collect()}
    # Of the two direct targets, each is out for the reference that it makes itself.
    assert got == {0: ("s1", "import_binding"), 1: ("s0", "import_binding"), **{i: (None, "unresolved") for i in range(2, n)}}
    assert most_rows(spark, since) < 20 * n


def test_policy_holds_an_edge_once(spark, monkeypatch):
    """Many rules take the same edges; a direct rule asks for one hop, and an end of very many edges lies in several buckets."""
    monkeypatch.setattr(policy, "BUCKET", 400)
    n, k, few = 1000, 20, 10
    edges = spark.range(n).selectExpr("concat('a', id) AS src", "'hub' AS dst", "'calls' AS kind").union(spark.range(n).selectExpr("concat('b', id)", "concat('a', id)", "'uses'"))
    assigned = spark.range(few).selectExpr("concat('b', id) AS id", "concat('p/', id) AS path", "'b' AS component").unionByName(spark.createDataFrame([("hub", "h", "hub")], "id string, path string, component string"))
    found = [(f"t{i}", "forbid", "transitive", ["b"], ["hub"], ["any"], "error") for i in range(k)] + [("calls only", "forbid", "transitive", ["b"], ["hub"], ["calls"], "error"), ("direct", "require", "direct", ["b"], ["hub"], ["any"], "error")]
    rules = spark.createDataFrame(found, "rule string, action string, reachability string, sources array<string>, targets array<string>, kinds array<string>, severity string")
    some = policy.path_violations(edges, assigned, rules.where("rule in ('t0', 'calls only', 'direct')"))
    assert {tuple(r) for r in some.groupBy("rule", "hops").count().collect()} == {("t0", 2, few), ("direct", None, few)}
    since = last_run(spark)
    policy.path_violations(edges, assigned.where("id <> 'hub'"), rules).collect()  # nothing is reached
    assert most_rows(spark, since) < k * n // 2


@pytest.mark.parametrize("wide, bits", [(1024, 512), (1024, 2), (4, 512), (0, 512)])
def test_transport_hops_form_a_pair_once(spark, monkeypatch, wide, bits):
    """Pairs that share many channels, by bits, by lists and by both."""
    monkeypatch.setattr(flow, "WIDE", wide)
    monkeypatch.setattr(flow, "BITS", bits)
    monkeypatch.setattr(flow, "SIDE", 16)
    rng = random.Random(5)
    rows = [(rng.choice("pc"), f"u{rng.randrange(50)}", str(int(rng.random() ** 2 * 90))) for _ in range(1500)] + [("p", "u1", None), ("c", None, "3"), ("p", "only", "rare"), ("c", "u2", "rare"), ("p", "alone", "nowhere")]
    e = spark.createDataFrame(rows, "side string, id string, channel string")
    since = last_run(spark)
    got = [tuple(r) for r in flow.transport_hops(e.where("side = 'p'"), e.where("side = 'c'")).collect()]
    want = {(a, b) for x, a, k in rows for y, b, m in rows if x == "p" and y == "c" and k == m and k and a and b and a != b}
    assert len(got) == len(set(got)) and set(got) == want
    if (wide, bits) == (1024, 512):
        assert most_rows(spark, since) <= len(want)


def test_transport_hops_meet_in_squares(spark, monkeypatch):
    """All publishers meet all consumers by a compiled hash join, a bounded number of either in a task, not row by row in a product."""
    monkeypatch.setattr(flow, "SIDE", 16)
    p = spark.range(100).selectExpr("concat('u', id) AS id", "CAST(id % 3 AS string) AS channel")
    c = spark.range(50, 120).selectExpr("concat('u', id) AS id", "CAST(id % 3 AS string) AS channel")
    since = last_run(spark)
    out = flow.transport_hops(p, c)
    got = [tuple(r) for r in out.collect()]
    want = {(f"u{a}", f"u{b}") for a in range(100) for b in range(50, 120) if a % 3 == b % 3 and a != b}
    assert len(got) == len(want) and set(got) == want
    store = spark._jsparkSession.sharedState().statusStore()
    plans = [store.planGraph(run).allNodes() for run in range(since + 1, last_run(spark) + 1)]
    names = {nodes.apply(j).name() for nodes in plans for j in range(nodes.length())}
    assert not any(n.startswith("CartesianProduct") for n in names) and any(n.startswith("ShuffledHashJoin") for n in names)
    sizes = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(n > 0 for n in sizes) > 10 and max(sizes) < len(want) // 3


def test_edges_are_made_distinct_in_tasks_of_bounded_rows(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    want = graphs.fk_edges(spark, sf).collect()
    monkeypatch.setattr(graphs, "DEALT", 200)
    edges = graphs.fk_edges(spark, sf)
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, want))
    sizes = edges.where("kind in ('includes', 'fulfilled_by', 'supplies')").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) > 10_000 and max(sizes) <= 2 * graphs.DEALT


@pytest.mark.parametrize("query", ["import_targets", "unresolved_imports"])
def test_an_import_is_resolved_once(spark, query):
    """Candidates are made of each different import, not of each part that writes it."""
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    since = last_run(spark)
    assert resolve_queries.QUERIES[query](spark, sf).count() > 0
    assert most_rows(spark, since) <= rows


@pytest.mark.parametrize("kind", ["path", "random", "star"])
def test_weak_components_shrink_the_graph(spark, monkeypatch, kind):
    """Later rounds have the links between ends alone; loops are nodes, null ends are none."""
    rng, n = random.Random(7), 300
    pairs = {"path": [(i, i + 1) for i in range(n)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(n)], "star": [(n, i) for i in range(n) if i % 3]}[kind] + [(900, 900), (None, 5), (None, 901)]
    tables, cut_table = [], graph.cut_table
    monkeypatch.setattr(graph, "cut_table", lambda d: tables.append(cut_table(d)) or tables[-1])
    got = dict(map(tuple, graph.weak_components(spark.createDataFrame(pairs, "src long, dst long")).collect()))
    root = {x: x for p in pairs if None not in p for x in p}
    for _ in root:
        for a, b in (p for p in pairs if None not in p):
            root[a] = root[b] = min(root[a], root[b])
    assert got == root
    links = [t.count() for t in tables if t.columns == ["src", "dst"]]
    assert links[-1] == 0 and all(2 * c <= a for a, c in zip(links, links[2:])) and len(tables) < 40


@pytest.mark.parametrize("ask", ["khop", "shortest_path", "walk", "impact"])
def test_walks_do_not_exchange_the_edges(spark, ask):
    n = 20_000
    edges = spark.range(n).selectExpr("concat('a:', id) AS src", "concat('a:', id + 1) AS dst", "'next' AS kind", "'parsed' AS evidence")
    edges = edges.union(edges.limit(100))
    seed = spark.createDataFrame([("a:7",)], "id string")
    since = last_run(spark)
    if ask == "khop":
        got = {tuple(r) for r in graph.khop(edges, seed, 3).collect()}
        assert got == {(f"a:{7 + k}", k) for k in range(4)}
    elif ask == "shortest_path":
        got = {tuple(r)[:3] for r in graph.shortest_path(edges, "a:300", "a:302").collect()}
        assert got == {(1, "a:300", "a:301"), (2, "a:301", "a:302")}
    elif ask == "walk":
        nodes, walked, frontier, stop = flow.walk(edges, seed, 2, 100)
        assert {tuple(r) for r in nodes.collect()} == {(f"a:{7 + k}", k) for k in range(3)} and stop == "MAX_DEPTH"
        assert sorted(map(tuple, walked.collect())) == [("a:7", "a:8", "next"), ("a:8", "a:9", "next")] and frontier.isEmpty()
    else:
        got = {tuple(r) for r in change.impact(edges, seed, 2).collect()}
        assert got == {("a:7", f"a:{7 - k}", k, "next", f"a:{8 - k}") for k in (1, 2)}
    assert most_rows(spark, since, "shuffle records written") < n // 4


def test_components_and_generations_broadcast_nothing(spark):
    """What is broadcast goes through the driver, once for each round."""
    rng = random.Random(9)
    edges = spark.createDataFrame([(rng.randrange(60), rng.randrange(60)) for _ in range(70)], "src long, dst long")
    since = last_run(spark)
    c = strong.strong_components(edges).localCheckpoint()
    flow.generations(c.select(c["component"].alias("id")).distinct(), flow.condensation(edges, c)).collect()
    strong.shortest_cycles(edges, c).collect()
    store = spark._jsparkSession.sharedState().statusStore()
    plans = [store.planGraph(run).allNodes() for run in range(since + 1, last_run(spark) + 1)]
    names = {nodes.apply(j).name() for nodes in plans for j in range(nodes.length())}
    assert "SortMergeJoin" in {n.split("(")[0].strip() for n in names} and not any(n.startswith("BroadcastExchange") for n in names)


def test_equal_spans_are_cut_up_once(spark):
    """Of many names of one span only the first is cut into blocks."""
    n = 2_000
    named = spark.range(n).select(F.lit("f").alias("file"), F.format_string("n%04d", F.col("id")).alias("name"), F.lit(1).alias("start"), F.lit(1_000).alias("end"))
    since = last_run(spark)
    got = spans.at_position(named, spark.createDataFrame([("f", 500)], "file string, at long")).collect()
    assert [tuple(r) for r in got] == [("f", 500, "n0000", 1, 1_000)]
    assert most_rows(spark, since) <= n


def test_cochange_deals_pairs_by_their_number(spark, tmp_path, monkeypatch):
    """Tasks take a bounded number of rows and of pairs, however many there are."""
    monkeypatch.setattr(joins, "TASK_ROWS", 100)
    orders = {o: sorted({(o * 7 + k * k) % 40 for k in range(o % 6)}) for o in range(300)}
    spark.createDataFrame([(o, p) for o, ps in orders.items() for p in ps * 2], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for ps in orders.values():
        for k, a in enumerate(ps):
            for b in ps[k + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    got = table_queries.cochange(spark, str(tmp_path))
    assert {(r["part_a"], r["part_b"]): r["n"] for r in got.collect()} == {k: n for k, n in want.items() if n >= 2}
    assert got.rdd.getNumPartitions() >= sum(want.values()) // 100
