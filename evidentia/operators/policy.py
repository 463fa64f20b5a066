"""Architecture policy as joins: components by path, rules as a table, violations, and their partition against a baseline.

components(component, prefix); rules(rule, action forbid | allow_only | require, reachability direct | transitive,
sources array<string>, targets array<string>, kinds array<string>, severity). Rules and components are written by
people and few; they are broadcast after a count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cuts import cut, cut_by, cut_table

#: Most rows of rules or prefixes that are broadcast; more are joined by exchange.
FEW = 100_000
#: Edges of a bucket; there are as many buckets as edges ask for.
BUCKET = 1_000_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def assign_components(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """(id, path, component): the component with the longest prefix of the node's path, whole segments; null if none has."""
    n = nodes.select("id", "path").withColumn("segments", F.split("path", "/"))
    prefixes = n.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("segments")), lambda k: F.array_join(F.slice("segments", 1, k), "/"))).alias("prefix"))
    best = prefixes.join(_few(components), "prefix").groupBy("id").agg(F.max_by("component", F.struct(F.length("prefix"), "component")).alias("component"))
    return nodes.select("id", "path").join(best, "id", "left")


def joined_edges(edges: DataFrame, assigned: DataFrame) -> DataFrame:
    """Edges whose source has a component, with from_component, to_component (null if unmapped) and both paths; none within a component."""
    a = assigned.select(F.col("id").alias("src"), F.col("component").alias("from_component"), F.col("path").alias("from_path")).where("from_component is not null")
    b = assigned.select(F.col("id").alias("dst"), F.col("component").alias("to_component"), F.col("path").alias("to_path"))
    e = edges.select("src", "dst", "kind").join(a, "src").join(b, "dst")
    return e.where(~F.col("from_component").eqNullSafe(F.col("to_component")))


def selects(kinds: Column, kind: Column) -> Column:
    """A rule takes edges of any kind, of runtime coupling (as all of ours are), or of the kinds it names."""
    return F.array_contains(kinds, "any") | F.array_contains(kinds, "runtime") | F.array_contains(kinds, kind)


def fingerprint(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def direct_violations(joined: DataFrame, rules: DataFrame) -> DataFrame:
    """(fingerprint, rule, severity, src, dst, kind, from_component, to_component) of direct forbid and allow_only rules."""
    r = rules.where("action in ('forbid', 'allow_only') and reachability = 'direct'").select("rule", "action", "severity", F.explode("sources").alias("from_component"), "targets", "kinds")
    hit = joined.join(_few(r), "from_component").where(selects(F.col("kinds"), F.col("kind")))
    listed = F.coalesce(F.array_contains("targets", F.col("to_component")), F.lit(False))
    hit = hit.where(F.when(F.col("action") == "forbid", listed).otherwise(~listed))
    return hit.select(fingerprint("rule", "src", "dst", "kind").alias("fingerprint"), "rule", "severity", "src", "dst", "kind", "from_component", "to_component").dropDuplicates(["fingerprint"])


def hops_to(edges: DataFrame, targets: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(rule, id, hops): for each rule's targets(rule, id) all nodes with a path to one, one hop at least. edges(src, dst, rules), once for all rules that take them.

    Goes on until nothing new is reached; with max_hops, longer paths are not looked for; targets may say for themselves by a column most
    how many hops are asked for (null: all). Edges are dealt by their ends once and stay there, only what is reached is exchanged.
    """
    e = cut_table(edges.select("src", "dst", "rules").where(F.size("rules") > 0))
    parts = max(int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-e.count() // BUCKET))
    # An end of very many edges, of which there can be few, lies in several buckets.
    hot = F.broadcast(cut(e.groupBy("dst").agg(F.ceil(F.count("*") * 4 / BUCKET).cast("int").alias("copies")).where("copies > 1")))
    one = F.coalesce("copies", F.lit(1))
    e = cut_by(e.join(hot, "dst", "left").withColumn("part", F.pmod(F.xxhash64("src"), one).cast("int")).drop("copies"), ["dst", "part"], parts)
    most = F.col("most") if "most" in targets.columns else F.lit(None).cast("int")
    front = cut_table(targets.select("rule", "id", most.alias("most")).distinct())
    seen, hop = None, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        going = front.where((F.col("most") >= hop) | F.col("most").isNull()).withColumnRenamed("id", "dst")
        going = going.join(hot, "dst", "left").withColumn("part", F.explode(F.sequence(F.lit(0), one - 1))).drop("copies")
        step = e.join(going, ["dst", "part"]).where(F.array_contains("rules", F.col("rule"))).select("rule", F.col("src").alias("id"), "most").distinct()
        if seen is not None:
            step = step.join(seen, ["rule", "id"], "left_anti")
        front = cut_table(step)
        if front.isEmpty():
            break
        found = front.select("rule", "id", F.lit(hop).cast("long").alias("hops"))
        seen = found if seen is None else seen.unionByName(found)
    return seen if seen is not None else front.select("rule", "id", F.lit(0).cast("long").alias("hops")).limit(0)


def path_violations(edges: DataFrame, assigned: DataFrame, rules: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(fingerprint, rule, severity, source_path, hops) of require rules (no path to a target, hops null) and transitive forbid rules (a path, of least hops).

    All paths of a rule's sources are found at once, backwards from its targets, so the work is one expansion for each hop; direct rules ask for one.
    """
    r = rules.where("action = 'require' or (action = 'forbid' and reachability = 'transitive')")
    # A rule takes the edges of the kinds it names; every edge is of kind any and of runtime coupling as well. One row an edge, whatever the rules.
    of = lambda rows: F.sort_array(F.collect_set(rows)).alias("rules")
    named = r.select(F.explode("kinds").alias("kind")).distinct().crossJoin(_few(r.select("rule", "kinds"))).where(selects(F.col("kinds"), F.col("kind"))).groupBy("kind").agg(of("rule"))
    others = r.where(F.array_contains("kinds", "any") | F.array_contains("kinds", "runtime")).agg(of("rule").alias("others"))  # one row
    taken = edges.select("src", "dst", "kind").join(_few(named), "kind", "left").crossJoin(F.broadcast(others)).select("src", "dst", F.coalesce("rules", "others").alias("rules"))
    ends = assigned.where("component is not null")
    one = F.when(F.col("reachability") == "direct", 1)
    targets = ends.join(_few(r.select("rule", one.alias("most"), F.explode("targets").alias("component"))), "component").select("rule", "id", "most")
    sources = ends.join(_few(r.select("rule", "action", "reachability", "severity", F.explode("sources").alias("component"))), "component")
    reach = hops_to(taken, targets, max_hops)
    near = F.when(F.col("reachability") == "direct", F.when(F.col("hops") == 1, F.col("hops"))).otherwise(F.col("hops"))
    by_path = sources.join(reach, ["rule", "id"], "left").withColumn("near", near).groupBy("rule", "action", "severity", F.col("path").alias("source_path")).agg(F.min("near").alias("hops"))
    bad = by_path.where(F.when(F.col("action") == "require", F.col("hops").isNull()).otherwise(F.col("hops").isNotNull()))
    return bad.select(fingerprint("rule", "action", "source_path").alias("fingerprint"), "rule", "severity", "source_path", "hops")


def ratchet(violations: DataFrame, baseline: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(fingerprint, rule, status): excepted, existing (in the baseline), warning, new, and fixed for what only the baseline(fingerprint) has."""
    v = violations.select("fingerprint", "rule", "severity").withColumn("present", F.lit(True))
    b = baseline.select("fingerprint").distinct().withColumn("known", F.lit(True))
    x = exceptions.select("fingerprint").distinct().withColumn("accepted", F.lit(True))
    j = v.join(b, "fingerprint", "full_outer").join(x, "fingerprint", "left")
    status = F.when(F.col("present").isNull(), "fixed").when(F.col("accepted"), "excepted").when(F.col("known"), "existing").when(F.col("severity") == "warn", "warning").otherwise("new")
    return j.select("fingerprint", "rule", status.alias("status"))


def over_budget(measures: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """(metric, subject, actual, allowed) of measures(metric, subject, actual) beyond their budget."""
    allowed = reduce(lambda c, kv: c.when(F.col("metric") == kv[0], F.lit(kv[1]).cast("long")), budgets.items(), F.when(F.lit(False), F.lit(0).cast("long")))
    return measures.withColumn("allowed", allowed).where("actual > allowed").select("metric", "subject", "actual", "allowed")


def capability_states(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """(capability, endpoint, state): served (owner as declared), drifted (another serves it), orphaned (none does), unmapped (served, not declared).

    declared(capability, endpoint, owner), observed(endpoint, owner).
    """
    o = observed.groupBy("endpoint").agg(F.collect_set("owner").alias("owners"))
    j = declared.join(o, "endpoint", "full_outer")
    state = F.when(F.col("capability").isNull(), "unmapped").when(F.col("owners").isNull(), "orphaned").when(F.array_contains("owners", F.col("owner")), "served").otherwise("drifted")
    return j.select("capability", "endpoint", state.alias("state"))
