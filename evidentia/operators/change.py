"""What changed between two snapshots, what it touches, and which checks it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cuts import cut, cut_table


def diff_nodes(before: DataFrame, after: DataFrame, compared: list[str]) -> DataFrame:
    """(id, change): nodes added, removed, or changed in one of the compared columns; nulls are equal."""
    x = before.select("id", F.struct(*compared).alias("was"))
    y = after.select("id", F.struct(*compared).alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return x.join(y, "id", "full_outer").select("id", change.alias("change")).where("change is not null")


def churn(changes: DataFrame, by: list[str]) -> DataFrame:
    """added, removed and total per group of changes(..., change)."""
    return changes.groupBy(*by).agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"), F.count_if(F.col("change").isin("added", "removed")).alias("total"))


def pair_declarations(before: DataFrame, after: DataFrame) -> DataFrame:
    """(before_id, after_id, stage): declarations(id, label, kind, path, print) matched one to one, in stages.

    First by id, then by (label, kind, path) where one declaration of each side is left with it, then by print likewise.
    What no stage matches has a null on the other side and stage none.
    """
    cols = ["id", "label", "kind", "path", "print"]
    b, a = before.select(*cols), after.select(*cols)
    same = cut(b.select("id").join(a.select("id"), "id"))
    pairs = same.select(F.col("id").alias("before_id"), F.col("id").alias("after_id"), F.lit("id").alias("stage"))
    b, a = b.join(same, "id", "left_anti"), a.join(same, "id", "left_anti")
    for stage, key in (("declaration", ["label", "kind", "path"]), ("print", ["print"])):
        one = lambda d, name: d.dropna(subset=key).groupBy(*key).agg(F.min("id").alias(name), F.count("*").alias("n")).where("n = 1").drop("n")
        hit = cut(one(b, "before_id").join(one(a, "after_id"), key).select("before_id", "after_id", F.lit(stage).alias("stage")))
        pairs = pairs.unionByName(hit)
        b = b.join(hit.select(F.col("before_id").alias("id")), "id", "left_anti")
        a = a.join(hit.select(F.col("after_id").alias("id")), "id", "left_anti")
    none = lambda x, y: (x.alias("before_id"), y.alias("after_id"), F.lit("none").alias("stage"))
    pairs = pairs.unionByName(b.select(*none(F.col("id"), F.lit(None).cast("string"))))
    return pairs.unionByName(a.select(*none(F.lit(None).cast("string"), F.col("id"))))


def classify_pairs(pairs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """pairs plus change: added, removed, signature (label or kind differs), moved (path), body (print), or unchanged."""
    x = before.select(F.col("id").alias("before_id"), *[F.col(c).alias(f"b_{c}") for c in ("label", "kind", "path", "print")])
    y = after.select(F.col("id").alias("after_id"), *[F.col(c).alias(f"a_{c}") for c in ("label", "kind", "path", "print")])
    j = pairs.join(x, "before_id", "left").join(y, "after_id", "left")
    differs = lambda c: ~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}"))
    change = (
        F.when(F.col("before_id").isNull(), "added").when(F.col("after_id").isNull(), "removed").when(differs("label") | differs("kind"), "signature")
        .when(differs("path"), "moved").when(differs("print"), "body").otherwise("unchanged")
    )
    return j.select("before_id", "after_id", "stage", change.alias("change"))


def impact(edges: DataFrame, seeds: DataFrame, depth: int, relations: tuple[str, ...] = (), blocked: tuple[str, ...] = ()) -> DataFrame:
    """(seed, id, distance, relation, via): what depends on each of seeds(id), within depth steps against the edges.

    A witness stands with each row: the least (relation, node) by which the hop came. Nodes of blocked kinds (before the
    colon of their id) are not reached. Every seed expands by itself, in one join for each step.
    """
    e = edges.where(F.col("kind").isin(*relations)) if relations else edges
    if blocked:
        e = e.where(~F.split("src", ":")[0].isin(*blocked))
    # Repeated edges stay, as a hop takes the least of them; tables have a size of their own, so a small frontier goes to the edges.
    step = cut_table(e.select("src", "dst", "kind"))
    front = cut_table(seeds.select(F.col("id").alias("seed"), "id").distinct())
    seen = front
    out = None
    for k in range(1, depth + 1):
        going = front.select("seed", F.col("id").alias("dst")).join(step, "dst").groupBy("seed", F.col("src").alias("id")).agg(F.min(F.struct("kind", "dst")).alias("w"))
        hits = cut_table(going.join(seen, ["seed", "id"], "left_anti").select("seed", "id", F.lit(k).cast("long").alias("distance"), F.col("w.kind").alias("relation"), F.col("w.dst").alias("via")))
        if hits.isEmpty():
            break
        out = hits if out is None else out.unionByName(hits)
        front = hits.select("seed", "id")
        seen = seen.unionByName(front)
    return out if out is not None else seen.select("seed", "id", F.lit(0).cast("long").alias("distance"), F.lit("").alias("relation"), F.lit("").alias("via")).limit(0)


def select_checks(hits: DataFrame, named: DataFrame, changed: DataFrame, most: int) -> DataFrame:
    """(check, distance, reasons): the checks a change needs, nearest first.

    hits(check, seed, distance) come by dependence, named(check, seed) by name, at distance 1, changed(check) are changed
    themselves, at distance 0. reasons are the distinct "kind:seed:distance", sorted.
    """
    rows = hits.select("check", "distance", F.concat_ws(":", F.lit("dependent"), "seed", "distance").alias("reason"))
    rows = rows.unionByName(named.select("check", F.lit(1).cast("long").alias("distance"), F.concat_ws(":", F.lit("name"), "seed", F.lit("1")).alias("reason")))
    rows = rows.unionByName(changed.select("check", F.lit(0).cast("long").alias("distance"), F.concat_ws(":", F.lit("changed"), "check", F.lit("0")).alias("reason")))
    best = rows.groupBy("check").agg(F.min("distance").alias("distance"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    return best.orderBy("distance", "check").limit(most)


def partition_findings(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(finding, status): new, existing or fixed, by finding id; each side's ids count once."""
    c = current.select("finding").distinct().withColumn("now", F.lit(True))
    b = baseline.select("finding").distinct().withColumn("was", F.lit(True))
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "fixed").otherwise("existing")
    return c.join(b, "finding", "full_outer").select("finding", status.alias("status"))


def hotspots(changes: DataFrame, degrees: DataFrame, top: int) -> DataFrame:
    """(path, changes, degree, score): changes(path, changes) times degree + 1, the top ones, ties by path."""
    j = changes.join(degrees, "path", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    return j.withColumn("score", F.col("changes") * (F.col("degree") + 1)).orderBy(F.desc("score"), "path").limit(top).select("path", "changes", "degree", "score")


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with key made unique: the second of a key gets ~2, the third ~3."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn(key, F.when(n > 1, F.concat(F.col(key), F.lit("~"), n)).otherwise(F.col(key)))
