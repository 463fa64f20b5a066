"""Strongly connected components of large graphs, and a shortest cycle through each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .cuts import cut, cut_table
from .joins import spread

#: Rounds in which nodes without edges in or out are taken off before chains are drawn together.
TRIM = 3


def dealt(d: DataFrame) -> DataFrame:
    """d for a join by exchange: there are very many joins here, and each that is broadcast would go through the driver."""
    return d.hint("merge")


def _ends(links: DataFrame) -> DataFrame:
    """(id, i, o, s): number of edges in and out, and the least successor."""
    both = links.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.col("dst").alias("s")).union(links.select("dst", F.lit(1), F.lit(0), F.lit(None)))
    return both.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.min("s").alias("s"))


def _trim(links: DataFrame) -> DataFrame:
    """links without those at a node that has none in or none out: such a node is on no cycle."""
    for _ in range(TRIM):
        cyclic = _ends(links).where("i > 0 and o > 0").select("id")
        links = cut(links.join(dealt(cyclic.withColumnRenamed("id", "src")), "src", "left_semi").join(dealt(cyclic.withColumnRenamed("id", "dst")), "dst", "left_semi").select("src", "dst"))
    return links


def _draw_chains(links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """links with each chain of nodes with one edge in and one out made one edge; inner(id, head, tail) of its nodes; rings(id, label).

    Pointers to a chain's last node double their reach each round, so a chain of n nodes takes log n rounds. Pointers that come
    round are rings of their own; the least id that a pointer passed is the ring's label.
    """
    single = cut(_ends(links).where("i = 1 and o = 1").select("id", "s"))
    p = single.join(dealt(single.select(F.col("id").alias("s"), F.lit(True).alias("on"))), "s", "left")
    # at: the farthest chain node known; open: whether the chain goes on there; least: the least id from id to before at.
    p = cut_table(p.select("id", F.when(F.col("on"), F.col("s")).otherwise(F.col("id")).alias("at"), F.coalesce("on", F.lit(False)).alias("open"), F.col("id").alias("least")))
    reach, turn, n = 1, 0, p.where("open").count()
    while n and reach <= n:
        q = p.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("open").alias("open2"), F.col("least").alias("least2"))
        j = p.where("open").join(dealt(q), "at").select("id", F.col("at2").alias("at"), F.col("open2").alias("open"), F.least("least", "least2").alias("least"))
        # What Spark believes of the size of a join is squared here; a table has a size of its own.
        p = (cut_table if turn % 3 == 2 else cut)(j.unionByName(p.where("not open")))
        reach, turn = reach * 2, turn + 1
        if p.where("open").isEmpty():
            break
    rings = p.where("open").select("id", F.col("least").alias("label"))
    chained = cut_table(p.where("not open").select("id", F.col("at").alias("last")))
    tails = chained.select("last").distinct().join(dealt(single.select(F.col("id").alias("last"), F.col("s").alias("tail"))), "last")
    heads = chained.join(dealt(links.select("src", F.col("dst").alias("id"))), "id").join(dealt(chained.select(F.col("id").alias("src"))), "src", "left_anti").select("last", F.col("src").alias("head"))
    ends = cut(heads.join(dealt(tails), "last"))
    inner = cut_table(spread(chained, dealt(ends), "last").select("id", "head", "tail"))
    gone = single.select("id")
    plain = links.join(dealt(gone.withColumnRenamed("id", "src")), "src", "left_anti").join(dealt(gone.withColumnRenamed("id", "dst")), "dst", "left_anti").select("src", "dst")
    drawn = ends.where("head <> tail").select(F.col("head").alias("src"), F.col("tail").alias("dst"))
    return cut_table(plain.union(drawn).distinct()), inner, cut_table(rings)


def _reach(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, f, b): what seeds(id) reach forwards and backwards; seeds themselves are both."""
    steps = cut(links.select("src", "dst", F.lit(True).alias("fore")).union(links.select("dst", "src", F.lit(False))).toDF("id", "to", "fore"))
    turn = 0
    seen = front = cut_table(seeds.select("id", F.explode(F.array(F.lit(True), F.lit(False))).alias("fore")))
    while True:
        turn += 1
        front = (cut_table if turn % 8 == 0 else cut)(front.join(dealt(steps), ["id", "fore"]).select(F.col("to").alias("id"), "fore").distinct().join(dealt(seen), ["id", "fore"], "left_anti"))
        if front.isEmpty():
            return seen.groupBy("id").agg(F.max("fore").alias("f"), F.max(~F.col("fore")).alias("b"))
        seen = cut(seen.unionByName(front))


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id of each node's strongly connected component, for all nodes of edges(src, dst).

    Nodes on no cycle are trimmed and chains drawn together; then, in all parts of the graph at once, what a pivot of the
    part reaches both ways is a component, and what it reaches one way, the other way and not at all are parts for the next
    round, with only edges inside them. The number of rounds grows with the logarithm of the graph, each takes as many steps as
    its pivots' reach. Nothing is gathered and no closure is built. Null ends are no nodes.
    """
    e = edges.select("src", "dst").where("src is not null and dst is not null")
    nodes = cut(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct())
    links, done, inner, turn = _trim(cut(e.where("src <> dst").distinct())), [], [], 0
    parts = None
    while True:
        if links.isEmpty():
            break
        links, chained, rings = _draw_chains(links)
        inner.append(chained)
        done.append(rings)
        links = _trim(links)
        if links.isEmpty():
            break
        left = cut(links.select(F.col("src").alias("id")).union(links.select("dst")).distinct())
        part = left.withColumn("part", F.lit(0).cast("long")) if parts is None else left.join(dealt(parts), "id")
        pivots = part.groupBy("part").agg(F.min_by("id", F.struct(F.xxhash64("id", F.lit(turn)), F.col("id"))).alias("id"))
        found = part.join(dealt(_reach(links, pivots)), "id", "left")
        side = F.coalesce(F.col("f").cast("int"), F.lit(0)) * 2 + F.coalesce(F.col("b").cast("int"), F.lit(0))
        new = cut_table(found.select("id", side.alias("side"), F.xxhash64("part", side, F.lit(turn)).alias("part")))
        both = new.where("side = 3").select("id", "part")
        done.append(spread(both, dealt(cut(both.groupBy("part").agg(F.min("id").alias("label")))), "part").select("id", "label"))
        parts = cut(new.where("side < 3").select("id", "part"))
        ends = links.join(dealt(parts.toDF("src", "a")), "src").join(dealt(parts.toDF("dst", "b")), "dst")
        links = cut_table(ends.where("a = b").select("src", "dst"))
        turn += 1
    # From the last chains to the first: a chain's nodes are its ends' component if these are of one.
    kind = nodes.schema["id"].dataType
    known = nodes.sparkSession.createDataFrame([], StructType([StructField("id", kind), StructField("label", kind)]))
    for d in done:
        known = cut(known.unionByName(d))
    for chained in reversed(inner):
        own = F.col("id")
        c = chained.join(dealt(known.toDF("head", "lh")), "head", "left").join(dealt(known.toDF("tail", "lt")), "tail", "left")
        label = F.when((F.col("head") == F.col("tail")) | (F.col("lh") == F.col("lt")), F.coalesce("lh", "head")).otherwise(own)
        # A head that is a chain's tail as well is on that cycle, if on no other.
        more = F.when((F.col("head") == F.col("tail")) & F.col("lh").isNull(), F.array(F.struct("id", label.alias("label")), F.struct(F.col("head").alias("id"), F.col("head").alias("label")))).otherwise(F.array(F.struct("id", label.alias("label"))))
        known = cut_table(known.unionByName(cut_table(c.select(F.explode(more).alias("x")).select("x.id", "x.label").distinct())))
    all_ = cut(nodes.join(dealt(known), "id", "left").select("id", F.coalesce("label", "id").alias("label")))
    least = all_.groupBy("label").agg(F.min("id").alias("component"), F.count("*").alias("n"))
    alone = all_.join(dealt(least.where("n > 1").select("label")), "label", "left_anti").select("id", F.col("id").alias("component"))
    return spread(cut(all_), dealt(cut(least.where("n > 1").select("label", "component"))), "label").select("id", "component").unionByName(alone)


def shortest_cycles(edges: DataFrame, components: DataFrame, longest: int | None = None) -> DataFrame:
    """(component, step, src, dst): a shortest cycle through the least member of each component of several nodes.

    Of paths of one length the one with the least predecessor at each node, from the end, is taken. With longest, cycles of more edges are not
    looked for; components without a row have none so short. All components are searched at once, one level a round.
    """
    many = components.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    c = components.join(dealt(many), "component", "left_semi").select("id", "component")
    e = edges.select("src", "dst").where("src <> dst").distinct()
    links = cut(e.join(dealt(c.toDF("src", "component")), "src").join(dealt(c.toDF("dst", "other")), "dst").where(F.col("component") == F.col("other")).select("component", "src", "dst"))
    seen = front = cut(many.select("component", F.col("component").alias("id"), F.lit(0).cast("long").alias("distance"), F.lit(None).cast(components.schema["id"].dataType).alias("before")))
    closed, k = None, 0
    while longest is None or k < longest:
        k += 1
        step = cut(front.select("component", F.col("id").alias("src")).join(dealt(links), ["component", "src"]).groupBy("component", F.col("dst").alias("id")).agg(F.min("src").alias("before")).withColumn("distance", F.lit(k).cast("long")))
        home = cut(step.where("id = component"))
        closed = home if closed is None else closed.unionByName(home)
        front = (cut_table if k % 8 == 0 else cut)(step.join(dealt(seen.select("component", "id")), ["component", "id"], "left_anti").join(dealt(home.select("component")), "component", "left_anti").select("component", "id", "distance", "before"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    at = cut(closed.select("component", F.col("distance").alias("step"), F.col("before").alias("src"), F.col("id").alias("dst")))
    out = at
    while not at.isEmpty():
        back = seen.select("component", F.col("id").alias("dst"), F.col("before").alias("next")).where("next is not null")
        k += 1
        at = (cut_table if k % 8 == 0 else cut)(at.select("component", (F.col("step") - 1).alias("step"), F.col("src").alias("dst")).join(dealt(back), ["component", "dst"]).select("component", "step", F.col("next").alias("src"), "dst"))
        out = out.unionByName(at)
    return out
