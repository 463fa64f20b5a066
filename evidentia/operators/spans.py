"""Positions in spans, and what is known of the symbol there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import cut, cut_table
from .joins import spread

#: Kinds of edges that refer to a symbol.
REFERENCE_KINDS = ("calls", "references", "implements", "extends", "imports", "exposes")


def blocks(start: Column, end: Column, levels: int) -> Column:
    """The fewest blocks (level, at) that make up start to end (not included): a block of level l is 2 ** l positions from at * 2 ** l on.

    There are at most two of a level, so a span of any length is a few dozen blocks, and each position lies in one of them.
    """
    lo, hi = start.cast("long"), end.cast("long")

    def of(level: int) -> list[Column]:
        # Inside start to end, the level's blocks are those from the first that begins there to the last that ends there; an odd one at an end has no block above.
        first, last = F.shiftright(lo + (1 << level) - 1, level), F.shiftright(hi, level)
        left = (first < last) & (first.bitwiseAND(F.lit(1)) != 0)
        right = (first + left.cast("long") < last) & (last.bitwiseAND(F.lit(1)) != 0)
        block = lambda at: F.struct(F.lit(level).alias("level"), at.alias("at"))
        return [F.when(left, block(first)), F.when(right, block(last - 1))]

    # No function of an array's elements but the last, as those are not compiled.
    return F.array_compact(F.array(*[b for level in range(levels + 1) for b in of(level)]))


def at_position(spans: DataFrame, points: DataFrame, rank: Column | None = None) -> DataFrame:
    """(file, at, name, start, end): the tightest of spans(file, name, start, end) that holds each of points(file, at); none is left out.

    start is inside, end is not, but an empty span holds its start. Of equally tight spans that of the least rank (a column of
    spans) wins, then the least name. Spans are cut into aligned blocks; of the spans that cover a block only the tightest is kept, and a
    point looks up its block of each level: no file's spans meet its points at one place, and no pair is formed that does not fit.
    Of equal spans only the first by rank and name is cut up; the levels go as far as the longest span asks.
    """
    s = spans.where("file is not null and start <= end").select("file", "name", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), (rank if rank is not None else F.lit(0)).alias("rank"))
    s = cut_table(s.groupBy("file", "start", "end").agg(F.min(F.struct("rank", "name")).alias("b")).select("file", "start", "end", "b.*"))
    far = s.agg(F.max(F.col("end") - F.col("start"))).first()[0]
    levels = max(1, int(far or 0).bit_length())
    last = F.when(F.col("start") == F.col("end"), F.col("end") + 1).otherwise(F.col("end"))
    best = F.struct((F.col("end") - F.col("start")).alias("area"), "rank", "name", "start", "end")
    held = s.select("file", best.alias("m"), F.explode(blocks(F.col("start"), last, levels)).alias("b")).groupBy("file", "b").agg(F.min("m").alias("m"))
    key = F.struct("file", "level", "block")
    held = cut_table(held.select(F.struct("file", "b.level", F.col("b.at").alias("block")).alias("k"), "m"))
    used = [r[0] for r in held.select("k.level").distinct().collect()]  # no more than there are bits
    p = points.select("file", F.col("at").cast("long").alias("at")).where("file is not null and at is not null").distinct()
    if not used:
        return p.join(s.select("file", "name", "start", "end").limit(0), "file")
    p = p.withColumn("level", F.explode(F.array(*map(F.lit, sorted(used))))).withColumn("block", F.expr("shiftright(at, level)"))
    found = spread(cut_table(p.select("file", "at", key.alias("k"))), held, "k").groupBy("file", "at").agg(F.min("m").alias("m"))
    return found.select("file", "at", "m.name", "m.start", "m.end")


def occurrence_at(usages: DataFrame, declarations: DataFrame, points: DataFrame) -> DataFrame:
    """(file, at, role, symbol, start, end): what stands at each of points(file, at): the tightest usage or declaration, of equal ones the usage.

    usages(file, symbol, start, end), declarations(file, symbol, start, end).
    """
    side = lambda d, role: d.select("file", F.concat_ws("\0", F.lit(role), "symbol").alias("name"), "start", "end", F.lit(role).alias("role"))
    found = at_position(side(usages, "usage").unionByName(side(declarations, "definition")), points, F.when(F.col("role") == "usage", 0).otherwise(1))
    parts = F.split("name", "\0", 2)
    return found.select("file", "at", parts[0].alias("role"), parts[1].alias("symbol"), "start", "end")


def owners(nodes: DataFrame) -> DataFrame:
    """(id, file) of nodes(id, kind, label, file): the file of a node's span, or, of a file's node, its label; others are left out."""
    return nodes.select("id", F.coalesce("file", F.when(F.col("kind") == "file", F.col("label"))).alias("file")).where("file is not null")


def references_of(subjects: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = REFERENCE_KINDS, offset: int = 0, limit: int = 50) -> DataFrame:
    """(symbol, place, total, src, kind, file, line, column): a page of the references to each of subjects(symbol), in order of file, line and column.

    edges(src, dst, kind, file, line, column). A place counts once, with the least source there; total is of all pages. The page's
    end limits what each task passes on of a symbol, so a symbol of very many references is not gathered.
    """
    asked = subjects.select("symbol").where("symbol is not null").distinct()
    r = edges.where(F.col("kind").isin(*kinds)).join(asked.withColumnRenamed("symbol", "dst"), "dst", "left_semi")
    r = cut_table(r.groupBy(F.col("dst").alias("symbol"), "file", "line", "column").agg(F.min(F.struct("src", "kind")).alias("m")).select("symbol", "m.src", "m.kind", "file", "line", "column"))
    total = cut(r.groupBy("symbol").agg(F.count("*").alias("total")))
    by = Window.partitionBy("symbol").orderBy("file", "line", "column")
    page = r.withColumn("place", F.row_number().over(by)).where(F.col("place") <= offset + limit).where(F.col("place") > offset)
    return page.join(total, "symbol").select("symbol", F.col("place").cast("long").alias("place"), "total", "src", "kind", "file", "line", "column")


def inspect_symbols(subjects: DataFrame, nodes: DataFrame, edges: DataFrame, docs: DataFrame, context: int = 8) -> DataFrame:
    """(symbol, kind, label, relations, source): of each of subjects(symbol) its node, how many edges of each kind go out and come in, and its lines.

    nodes(id, kind, label, file, line), edges(src, dst, kind), docs(file, text). relations is a sorted array of "out|in kind count";
    source is context lines before and after the node's first line, null without a text. A hub's edges are counted before they meet it.
    """
    asked = subjects.select("symbol").where("symbol is not null").distinct()
    ends = edges.select(F.col("src").alias("symbol"), F.concat(F.lit("out "), "kind").alias("r")).union(edges.select("dst", F.concat(F.lit("in "), "kind")))
    counts = ends.join(asked, "symbol", "left_semi").groupBy("symbol", "r").agg(F.count("*").alias("n"))
    relations = counts.groupBy("symbol").agg(F.array_sort(F.collect_list(F.concat_ws(" ", "r", "n"))).alias("relations"))  # as many as kinds
    n = asked.join(nodes.withColumnRenamed("id", "symbol"), "symbol")
    first = F.greatest(F.lit(1), F.col("line") - context)
    lines = F.array_join(F.slice(F.split("text", "\n"), first, F.col("line") + context - first + 1), "\n")
    n = n.join(docs.select("file", "text"), "file", "left").select("symbol", "kind", "label", lines.alias("source"))
    return n.join(relations, "symbol", "left").select("symbol", "kind", "label", F.coalesce("relations", F.array().cast("array<string>")).alias("relations"), "source")
