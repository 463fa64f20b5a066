"""Questions about texts: lines, spans, findings, and what fits a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import cut_table
from .spans import at_position  # noqa: F401

#: Consecutive rows that are summed together before a budget is drawn.
BLOCK = 64


def matching_lines(docs: DataFrame, matches, per_document: int, before: int = 0, after: int = 0) -> DataFrame:
    """(id, line_no, total, context): a document's first per_document matching lines of docs(id, text), its total of them, and the lines about.

    A text is cut and searched once, in its own row; matches is a function of a line.
    """
    lines = F.split("text", "\n")
    # Through explode, so that lines and hits are made once.
    d = docs.select("id", F.explode(F.array(lines)).alias("lines"))
    hits = F.filter(F.transform("lines", lambda x, i: F.when(matches(x), i + 1)), lambda i: i.isNotNull())
    d = d.select("id", "lines", F.explode(F.array(hits)).alias("hits")).where(F.size("hits") > 0)
    d = d.select("id", "lines", F.size("hits").cast("long").alias("total"), F.explode(F.slice("hits", 1, per_document)).alias("at"))
    first = F.greatest(F.lit(1), F.col("at") - before)
    context = F.array_join(F.slice("lines", first, F.col("at") + after - first + 1), "\n")
    return d.select("id", F.col("at").cast("long").alias("line_no"), "total", context.alias("context"))


def line_findings(docs: DataFrame, rules: list[tuple[str, str, str]], floor: str = "low", longest: int = 400) -> DataFrame:
    """(finding, rule, severity, id, line_no) of lines of docs(id, text) that a rule (name, severity, pattern) fits, from severity floor on.

    Lines over longest bytes are generated content and are skipped. A finding's id holds when lines shift: rule, document and the
    line's digest with white space made one blank; equal lines of a document share it.
    """
    from ..functions.text import SEVERITIES

    rules = [r for r in rules if SEVERITIES.index(r[1]) >= SEVERITIES.index(floor)]
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("p", "line")).where(F.octet_length("line") <= longest)
    which = F.filter(F.array(*[F.when(F.col("line").rlike(pattern), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, severity, pattern in rules]), lambda r: r.isNotNull())
    hit = lines.select("id", "p", "line", F.explode(which).alias("r"))
    digest = F.sha2(F.btrim(F.regexp_replace("line", r"[\x20\x09-\x0D]+", " ")), 256)
    return hit.select(F.concat_ws(":", "r.rule", "id", digest).alias("finding"), "r.rule", "r.severity", "id", (F.col("p") + 1).cast("long").alias("line_no"))


def block_duplicates(docs: DataFrame, size: int = 24, least: int = 3) -> DataFrame:
    """(digest, n, first_id, first_line): blocks of size lines, tumbling, of at least least lines, that stand in texts more than once."""
    lines = F.split("text", "\n")
    d = docs.select("id", F.explode(F.array(lines)).alias("lines"))
    starts = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / size).cast("int"))
    blocks = d.select("id", F.explode(F.transform(starts, lambda k: F.struct((k * size + 1).alias("line"), F.slice("lines", k * size + 1, size).alias("b")))).alias("x")).where(F.size("x.b") >= least)
    g = blocks.groupBy(F.sha2(F.array_join("x.b", "\n"), 256).alias("digest")).agg(F.count("*").alias("n"), F.min(F.struct("id", "x.line")).alias("f"))
    return g.where("n > 1").select("digest", "n", F.col("f.id").alias("first_id"), F.col("f.line").cast("long").alias("first_line"))


def _suffixes(path: Column) -> Column:
    """The last one, two, ... segments of a path, joined; blanks, dots and drives are no segments."""
    s = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != ".") & ~x.endswith(":"))
    return F.transform(F.sequence(F.lit(1), F.size(s)), lambda k: F.array_join(F.slice(s, -k, k), "/"))


def match_frames(files: DataFrame, frames: DataFrame) -> DataFrame:
    """(frame, matched, overlap, file): the file(path) that shares the most last segments with each frame(frame): one, many (file is the least) or none.

    Files are counted by each of their endings first, so a common file name is one row, not all files of that name.
    """
    f = files.select("path").distinct()
    known = f.select("path", F.explode(_suffixes(F.col("path"))).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("n"), F.min("path").alias("file"))
    s = frames.select("frame").distinct()
    tails = s.select("frame", F.posexplode(_suffixes(F.col("frame"))).alias("p", "suffix")).join(known, "suffix")
    best = tails.groupBy("frame").agg(F.max_by(F.struct("n", "file", "p"), "p").alias("b"))
    j = s.join(best, "frame", "left")
    matched = F.when(F.col("b").isNull(), "none").when(F.col("b.n") == 1, "one").otherwise("many")
    return j.select("frame", matched.alias("matched"), F.coalesce(F.col("b.p") + 1, F.lit(0)).cast("long").alias("overlap"), F.col("b.file").alias("file"))


def fit_budget(rows: DataFrame, group: str, order: str, size: str, budget: int, block: int = BLOCK) -> DataFrame:
    """rows(group, order, size) plus used: the latest rows of each group, by order (a whole number), whose running size is within budget.

    Sizes are first summed in blocks of order; blocks that begin beyond the budget go, so only the few that are left are put in
    order, block by block, and no long group passes through one task. Null sizes are 0.
    """
    b = F.floor(F.col(order) / block)
    rows = rows.withColumn("_b", b).withColumn("_s", F.coalesce(F.col(size), F.lit(0)).cast("long"))
    sums = rows.groupBy(group, "_b").agg(F.sum("_s").alias("_t"))
    later = F.sum("_t").over(Window.partitionBy(group).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1))
    kept = sums.withColumn("_before", F.coalesce(later, F.lit(0))).where(F.col("_before") <= budget).select(group, "_b", "_before")
    within = F.sum("_s").over(Window.partitionBy(group, "_b").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.join(kept, [group, "_b"]).withColumn("used", F.col("_before") + within)
    return out.where(F.col("used") <= budget).drop("_b", "_s", "_before")


def by_quota(rows: DataFrame, group: str, bucket: str, order: list[str], quotas: dict[str, int], most: int) -> DataFrame:
    """The first rows of each group and bucket up to the bucket's quota, in the quotas' order, most of a group in all; plus rank within the group.

    Each bucket has its own limit, as a number, so every task passes on no more than that of a group: a hub's rows are not gathered to be ranked.
    """
    rows = cut_table(rows.where(F.col(bucket).isin(*quotas)))
    by, taken = Window.partitionBy(group).orderBy(*order), None
    for k, (name, n) in enumerate(quotas.items()):
        own = rows.where(F.col(bucket) == name).withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= n).withColumn("_k", F.lit(k))
        taken = own if taken is None else taken.unionByName(own)
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_k", "_n"))
    return taken.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).drop("_n", "_k")


def with_page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page of rows in order, with total, has_more and next_offset (null at the end) on each row."""
    total = rows.count()
    more = offset + limit < total
    page = rows.orderBy(*order).offset(offset).limit(limit)
    return page.withColumns({"total": F.lit(total).cast("long"), "has_more": F.lit(more), "next_offset": F.lit(offset + limit if more else None).cast("long")})
