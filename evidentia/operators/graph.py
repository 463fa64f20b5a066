"""Graph questions over nodes(id, kind, label, path) and edges(src, dst, kind, evidence)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cuts import cut_table


def census(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes by kind, and of edges by kind and by evidence."""
    count = lambda d, c, what: d.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(what).alias("census"), "name", "n")
    return reduce(DataFrame.unionByName, [count(nodes, "kind", "node_kind"), count(edges, "kind", "relation"), count(edges, "evidence", "evidence")])


def degrees(edges: DataFrame) -> DataFrame:
    """Out- and in-degree per node in one shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def hubs(edges: DataFrame, hidden: tuple[str, ...], top_n: int) -> DataFrame:
    """The top_n nodes by degree, ties by id; ids that start with a hidden kind are left out."""
    d = degrees(edges).withColumn("degree", F.col("out_degree") + F.col("in_degree"))
    return d.where(~F.split("id", ":")[0].isin(*hidden)).orderBy(F.desc("degree"), "id").limit(top_n)


def neighbours(edges: DataFrame, node: str, relations: tuple[str, ...] = (), offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of a node's edges, outgoing first, with the total before the cut."""
    e = edges.where(F.col("kind").isin(*relations)) if relations else edges
    out = e.where(F.col("src") == node).select(F.lit("out").alias("direction"), F.col("dst").alias("id"), "kind", "evidence")
    both = out.unionByName(e.where(F.col("dst") == node).select(F.lit("in").alias("direction"), F.col("src").alias("id"), "kind", "evidence"))
    total = both.agg(F.count("*").alias("total"))
    page = both.orderBy(F.desc("direction"), "id", "kind").offset(offset).limit(limit)
    return page.join(F.broadcast(total))  # one row


def khop(edges: DataFrame, seeds: DataFrame, depth: int | None, reverse: bool = False, blocked: tuple[str, ...] = (), until: str | None = None) -> DataFrame:
    """(id, distance) of all nodes within depth steps of seeds(id), of all that are reached if depth is null; nodes of blocked kinds are reached but not passed.

    With until, no step is made beyond the one that reaches that node.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    # Cut once: each step then reads the edge list. Tables have a size of their own, so a small frontier goes to the edges, which are not
    # exchanged; nor are they made distinct, as the frontier is.
    step = cut_table(edges.select(F.col(a).alias("id"), F.col(b).alias("to")))
    seen = cut_table(seeds.select("id").distinct().withColumn("distance", F.lit(0).cast("long")))
    front, k = seen, 0
    while depth is None or k < depth:
        k += 1
        going = front.where(~F.split("id", ":")[0].isin(*blocked)) if blocked else front
        front = cut_table(going.join(step, "id").select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("distance", F.lit(k).cast("long")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if until is not None and not front.where(F.col("id") == until).isEmpty():
            break
    return seen


def shortest_path(edges: DataFrame, source: str, target: str, max_hops: int = 8) -> DataFrame:
    """All edges that lie on some shortest directed path: (hop, src, dst, kind, evidence), parallel relations kept."""
    spark, edges = edges.sparkSession, cut_table(edges)
    ahead = khop(edges, spark.createDataFrame([(source,)], "id string"), max_hops, until=target)
    found = ahead.where(F.col("id") == target).first()
    if found is None:
        return edges.limit(0).select(F.lit(0).cast("long").alias("hop"), "src", "dst", "kind", "evidence")
    back = khop(edges, spark.createDataFrame([(target,)], "id string"), found["distance"], reverse=True)
    e = edges.join(ahead.select(F.col("id").alias("src"), F.col("distance").alias("da")), "src").join(back.select(F.col("id").alias("dst"), F.col("distance").alias("db")), "dst")
    return e.where(F.col("da") + F.col("db") + 1 == found["distance"]).select((F.col("da") + 1).alias("hop"), "src", "dst", "kind", "evidence")


def _followed(up: DataFrame) -> DataFrame:
    """up(id, root) with each pointer followed to its end; their reach doubles each round. Pointers lead to ids of up that are no greater."""
    while True:
        far = cut_table(up.join(up.toDF("root", "far"), "root").select("id", F.col("root").alias("old"), F.col("far").alias("root")))
        up = far.select("id", "root")
        if far.where("old <> root").isEmpty():
            return up


def weak_components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable; null ends are no nodes, and nothing is gathered.

    Each node points at the least of itself and its neighbours. The ends of these pointers are the nodes of a smaller graph that keeps
    only links between unlike ends. An end that nothing points at has a lesser neighbour there, so two rounds at least halve the nodes.
    """
    links, rounds = cut_table(edges.select("src", "dst").where("src is not null and dst is not null")), []
    while not rounds or not links.isEmpty():
        least = links.union(links.select("dst", "src")).toDF("id", "to").groupBy("id").agg(F.min("to").alias("to"))
        up = _followed(cut_table(least.select("id", F.least("id", "to").alias("root"))))
        rounds.append(up)
        ends = links.join(up.toDF("src", "a"), "src").join(up.toDF("dst", "b"), "dst").where("a <> b")
        links = cut_table(ends.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    out = rounds.pop()
    while rounds:
        out = cut_table(rounds.pop().join(out.toDF("root", "end"), "root", "left").select("id", F.coalesce("end", "root").alias("root")))
    return out.withColumnRenamed("root", "component")


def diff_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    """(src, dst, kind, change): edges added or removed, or whose evidence changed; null evidence is equal to itself alone."""
    side = lambda d, k: d.select("src", "dst", "kind", F.col("evidence").alias(f"e{k}"), F.lit(True).alias(f"in{k}"))
    d = side(before, 0).join(side(after, 1), ["src", "dst", "kind"], "full_outer")
    change = F.when(F.col("in0").isNull(), "added").when(F.col("in1").isNull(), "removed").when(~F.col("e0").eqNullSafe(F.col("e1")), "changed")
    return d.select("src", "dst", "kind", change.alias("change")).where("change is not null")


def module_rollup(nodes: DataFrame, depth: int, top_n: int) -> DataFrame:
    """Nodes and their kinds per path prefix of depth parts."""
    prefix = F.array_join(F.slice(F.split("path", "/"), 1, depth), "/")
    return nodes.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n"), F.count_distinct("kind").alias("kinds")).orderBy(F.desc("n"), "prefix").limit(top_n)


