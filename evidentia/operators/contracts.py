"""Contracts between those who provide or produce and those who call or consume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cuts import cut


def event_verdicts(observations: DataFrame, key: str) -> DataFrame:
    """(key, producers, consumers, declared, verdict) of observations(key, role): MATCH, UNPAIRED or CONFIGURATION_ONLY."""
    n = lambda role: F.count_if(F.col("role") == role)
    g = observations.groupBy(key).agg(n("producer").alias("producers"), n("consumer").alias("consumers"), n("configuration").alias("declared"))
    verdict = F.when((F.col("producers") > 0) & (F.col("consumers") > 0), "MATCH").when((F.col("producers") == 0) & (F.col("consumers") == 0), "CONFIGURATION_ONLY").otherwise("UNPAIRED")
    return g.withColumn("verdict", verdict)


def kind_mismatches(observations: DataFrame) -> DataFrame:
    """(code, resource, producer, consumer): pairs of unlike family or entity on one resource; observations(resource, role, family, entity).

    Sides are made distinct before they meet, so a resource makes no more pairs than there are kinds of observations. A jms
    destination fits every entity.
    """
    side = lambda role: observations.where(F.col("role") == role).select("resource", "family", "entity").distinct()
    p, c = side("producer").alias("p"), side("consumer").alias("c")
    j = p.join(c, F.col("p.resource") == F.col("c.resource"))
    loose = (F.col("p.family") == "jms") & ((F.col("p.entity") == "destination") | (F.col("c.entity") == "destination"))
    code = F.when(F.col("p.family") != F.col("c.family"), "TRANSPORT_MISMATCH").when((F.col("p.entity") != F.col("c.entity")) & ~loose, "DESTINATION_KIND_MISMATCH")
    return j.select(code.alias("code"), F.col("p.resource").alias("resource"), F.concat_ws(":", "p.family", "p.entity").alias("producer"), F.concat_ws(":", "c.family", "c.entity").alias("consumer")).where("code is not null")


def quoted(text: Column) -> Column:
    """text as a pattern for itself."""
    return F.regexp_replace(text, r"([^A-Za-z0-9_/ -])", r"\\$1")


def routes(key: Column, binding: Column) -> Column:
    """Whether a routing key fits a topic binding: words between dots, * is one word, # any number of them, none included; null fits nothing."""
    word = lambda w: F.when(w == "#", F.lit("([.][^.]*)*")).when(w == "*", F.lit("[.][^.]*")).otherwise(F.concat(F.lit("[.]"), quoted(w)))
    pattern = F.concat(F.lit("^"), F.array_join(F.transform(F.split(binding, "[.]"), word), ""), F.lit("$"))
    return F.coalesce(F.rlike(F.concat(F.lit("."), key), pattern), F.lit(False))


def routed(producers: DataFrame, bindings: DataFrame, consumers: DataFrame) -> DataFrame:
    """(exchange, routing_key, binding, queue, consumer, routing): COMPATIBLE or AMQP_ROUTING_KEY_MISMATCH for each producer, binding and consumer that meet.

    producers(exchange, routing_key), bindings(exchange, binding, queue), consumers(queue, consumer), each made distinct first.
    """
    j = producers.distinct().join(bindings.distinct(), "exchange").join(consumers.distinct(), "queue")
    fit = F.when(routes(F.col("routing_key"), F.col("binding")), "COMPATIBLE").otherwise("AMQP_ROUTING_KEY_MISMATCH")
    return j.select("exchange", "routing_key", "binding", "queue", "consumer", fit.alias("routing"))


def typed_matches(providers: DataFrame, clients: DataFrame) -> DataFrame:
    """(client, identity, mode, state, expected) of clients(client, identity, mode) against providers(identity, mode).

    matched if the very signature is provided, MODE_MISMATCH if its identity is but in other modes (expected, sorted), else MISSING_PROVIDER.
    """
    by = providers.groupBy("identity").agg(F.array_sort(F.collect_set("mode")).alias("modes"))
    j = clients.distinct().join(by, "identity", "left")
    state = F.when(F.col("modes").isNull(), "MISSING_PROVIDER").when(F.array_contains("modes", F.col("mode")), "matched").otherwise("MODE_MISMATCH")
    expected = F.when(state == "MODE_MISMATCH", F.array_join("modes", ",")).otherwise("")
    return j.select("client", "identity", "mode", state.alias("state"), expected.alias("expected"))


def _segments(path: Column) -> Column:
    """A path's segments; one slash at its end adds none."""
    return F.split(F.regexp_replace(path, "(.)/$", "$1"), "/")


def _free(segment: Column) -> Column:
    return F.contains(segment, F.lit("*")) | F.contains(segment, F.lit("{")) | F.contains(segment, F.lit(":"))


def route_templates(routes_: DataFrame) -> DataFrame:
    """routes(route, method) plus prefix, what stands before the first parameter, and patterns: of each segment the pattern it is matched by.

    {name} and :name stand for what is left of a segment or for a part of it, * for any of its characters; all else stands for itself.
    """
    marked = lambda x: F.regexp_replace(x, r"(\{[^}]*\}|:[A-Za-z0-9_]+|[*])", "\0")
    pattern = lambda x: F.concat(F.lit("^"), F.array_join(F.transform(F.split(marked(x), "\0", -1), quoted), "[^/]+"), F.lit("$"))
    return routes_.withColumn("prefix", F.regexp_extract("route", r"^([^{:*]*)", 1)).withColumn("patterns", F.transform(_segments(F.col("route")), pattern))


def http_matches(endpoints: DataFrame, calls: DataFrame, few: int = 10_000) -> DataFrame:
    """(call, path, method, route, state) of calls(call, path, method): matched, METHOD_MISMATCH, or MISSING_ENDPOINT with a null route.

    Routes and paths meet by number of segments and first segment, as it is or free, and are compared segment by segment. The longest
    fixed prefix wins, then the greatest route. endpoints(route, method) are written by people; few are broadcast after a count.
    """
    # A path that begins with a slash has an empty segment before its first one.
    lead = lambda s: F.coalesce(F.get(s, F.when(F.get(s, F.lit(0)) == "", 1).otherwise(0)), F.lit(""))
    s = _segments(F.col("route"))
    r = cut(route_templates(endpoints.distinct()).withColumn("n", F.size(s)).withColumn("lead", F.when(_free(lead(s)), "*").otherwise(lead(s))))
    r = F.broadcast(r) if r.limit(few + 1).count() <= few else r
    c = calls.withColumn("segments", _segments(F.col("path"))).withColumn("n", F.size("segments")).withColumn("lead", F.explode(F.array_distinct(F.array(lead(F.col("segments")), F.lit("*")))))
    fits = F.forall(F.zip_with("segments", "patterns", lambda x, p: F.rlike(x, p)), lambda ok: ok)
    hit = c.join(r.withColumnRenamed("method", "offered"), ["n", "lead"]).where(fits)
    best = hit.groupBy("call", "path", "method").agg(F.max_by(F.struct("route"), F.struct(F.col("offered") == F.col("method"), F.length("prefix"), "route")).alias("b"), F.max(F.col("offered") == F.col("method")).alias("same"))
    state = F.when(F.col("b").isNull(), "MISSING_ENDPOINT").when(F.col("same"), "matched").otherwise("METHOD_MISMATCH")
    return calls.join(best, ["call", "path", "method"], "left").select("call", "path", "method", F.col("b.route").alias("route"), state.alias("state"))


def merge_runtime(static: DataFrame, runtime: DataFrame, as_of: str, max_age_days: int) -> DataFrame:
    """(key, evidence, freshness): static(key) and runtime(key, at) observations merged: both, static_only or runtime_only; fresh, stale or none at as_of."""
    r = runtime.groupBy("key").agg(F.max("at").alias("at"))
    j = static.select("key", F.lit(True).alias("s")).distinct().join(r.withColumn("r", F.lit(True)), "key", "full_outer")
    evidence = F.when(F.col("s") & F.col("r"), "both").when(F.col("s"), "static_only").otherwise("runtime_only")
    age = F.datediff(F.lit(as_of).cast("date"), F.col("at").cast("date"))
    fresh = F.when(F.col("at").isNull(), "none").when(age <= max_age_days, "fresh").otherwise("stale")
    return j.select("key", evidence.alias("evidence"), fresh.alias("freshness"))


def schema_states(before: DataFrame, after: DataFrame) -> DataFrame:
    """(member, state) of members(member, type, required) before and after: added, added_required, removed, retyped, now_required or kept.

    A consumer of the earlier schema breaks on added_required, removed, retyped and now_required.
    """
    x = before.select("member", F.struct("type", "required").alias("b"))
    y = after.select("member", F.struct("type", "required").alias("a"))
    j = x.join(y, "member", "full_outer")
    state = (
        F.when(F.col("b").isNull(), F.when(F.col("a.required"), "added_required").otherwise("added")).when(F.col("a").isNull(), "removed")
        .when(~F.col("a.type").eqNullSafe(F.col("b.type")), "retyped").when(F.col("a.required") & ~F.col("b.required"), "now_required").otherwise("kept")
    )
    return j.select("member", state.alias("state"))
