"""Line dedup by an exact set-similarity join, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW, cut, cut_table, fresh, keyed, small, table, words_of

#: Token frequencies are kept by hash slot, a byte each, so the table has a fixed length whatever the vocabulary.
SLOTS = 131_072
#: A line text with more than one in so many of all lines is common: there are fewer such texts than this.
COMMON = 4096
#: Sizes and positions in an index entry stop at this; the bounds that need them then pass.
MOST = 65_535
#: Rounds in which lines are compared with the first line of each of their tokens only.
ROUNDS = 2


#: A line's place in the order by (id, line), as one number.
PLACE = "cast(id as decimal(20,0)) * 2147483648 + line"


def _lines(docs: DataFrame) -> DataFrame:
    """(id, line, t, key, pos): every line that is not blank, the hash of its text and its place."""
    d = docs.select("id", F.posexplode(F.split("text", "\n")).alias("line", "t")).where("trim(t) <> ''")
    return d.withColumns({"key": F.xxhash64("t"), "pos": F.expr(PLACE)})


def _rarity(lines: DataFrame) -> DataFrame:
    """One row of SLOTS / 8 longs: eight bits for each hash slot's count of tokens (eighths of log2, about the mean)."""
    words = lines.select(F.explode(words_of("t")).alias("w")).where("w <> ''")
    slots = cut(words.groupBy(F.xxhash64("w").bitwiseAND(SLOTS - 1).cast("int").alias("k")).agg(F.count("*").alias("n")))
    mean = (slots.agg(F.sum("n")).first()[0] or 1) / SLOTS
    level = F.least(F.lit(255), F.greatest(F.lit(0), F.round(8 * F.log2(F.col("n") / mean)) + 128)).cast("long")
    packed = slots.select("k", level.alias("e")).groupBy(F.expr("k div 8").alias("at")).agg(F.expr("bit_or(shiftleft(e, (k % 8) * 8))").alias("bits"))
    every = lines.sparkSession.range(SLOTS // 8).select(F.col("id").alias("at")).join(F.broadcast(packed), "at", "left")
    # It is asked for by a subquery, as the driver keeps several texts of each plan, and so of what is written into one.
    return cut(every.agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))["bits"].alias("levels")))


def _sets(lines: DataFrame, levels: DataFrame) -> DataFrame:
    """(key, o): distinct ranks of each text's tokens, rarest first; a rank is eight bits for the level of the token's slot, then the token's hash."""

    def rank(w: Column, table: Column) -> Column:
        slot = w.bitwiseAND(SLOTS - 1)
        bits = F.get(table, F.shiftright(slot, 3).cast("int"))
        e = F.call_function("shiftright", bits, (slot.bitwiseAND(7) * 8).cast("int")).bitwiseAND(255)
        return F.shiftleft(e, 55).bitwiseOR(F.shiftrightunsigned(w, 9))

    words = F.transform(F.array_remove(words_of("t"), ""), lambda w: F.xxhash64(w))
    ranks = F.transform(F.array(F.struct(words.alias("w"), F.col("levels").alias("l"))), lambda x: F.transform(x["w"], lambda w: rank(w, x["l"])))[0]
    # Columns of their own, as a subquery may not stand in a transform, and then through explode, so that the set is made once and not for each use.
    made = lines.withColumn("levels", levels.scalar()).select("key", F.sort_array(F.array_distinct(ranks)).alias("o"))
    return made.select("key", F.explode(F.array("o")).alias("o"))


def _index(lines: DataFrame, levels: DataFrame, percent: int) -> DataFrame:
    """(c, key, s) per line and prefix token: c packs token, set size and position in 32, 16 and 16 bits; s is the set's parity sketch.

    Bit b of s tells whether an odd number of tokens hash to b, so two sets differ in as many tokens as sketches in bits, at least.
    """
    sets = _sets(lines, levels)
    sketch = F.expr("aggregate(o, 0L, (a, w) -> a ^ shiftleft(1L, cast(w & 63 as int)))")
    sets = sets.withColumns({"n": F.size("o"), "s": sketch}).where("n > 0")
    # Sets too short to be similar to any but equal ones have one entry, for the whole set.
    short = f"n * 100 < {percent} * (n + 1) and (n - 1) * 100 < {percent} * n"
    prefix = f"if({short}, array(xxhash64(o)), slice(o, 1, n - cast(ceil({percent} * n / 100D) as int) + 1))"
    entries = sets.select("key", "n", "s", F.posexplode(F.expr(prefix)).alias("p", "w"))
    return entries.select(F.expr(f"shiftleft(w, 32) | shiftleft(cast(least(n, {MOST}) as bigint), 16) | least(p, {MOST})").alias("c"), "key", "s")


def _near(percent: int) -> str:
    """Whether entries x and y of one token can be of similar sets, by size, position and sketch; false for none that are, at their first shared token."""
    nx, ny, px, py = "(shiftright(x.c, 16) & 65535)", "(shiftright(y.c, 16) & 65535)", "(x.c & 65535)", "(y.c & 65535)"
    size = f"100 * least({nx}, {ny}) >= {percent} * greatest({nx}, {ny})"
    # Sets of sizes n and m at that similarity share percent * (n + m) / (100 + percent) tokens at least.
    place = f"least({nx} - {px}, {ny} - {py}) * {100 + percent} >= {percent} * ({nx} + {ny})"
    sketch = f"bit_count(x.s ^ y.s) * {100 + percent} <= ({nx} + {ny}) * {100 - percent}"
    return f"(greatest({nx}, {ny}) = {MOST} or ({size} and {place} and {sketch}))"


TOKEN = "shiftrightunsigned({}.c, 32)"


def _wide(o: str) -> str:
    """Four longs of parity sketch over a set, for pairs: long sets that share a word differ in many of these bits, too."""
    bits = [f"aggregate({o}, 0L, (a, w) -> if(w & 192 = {b << 6}, a ^ shiftleft(1L, cast(w & 63 as int)), a))" for b in range(4)]
    return f"array({', '.join(bits)})"


def _near_wide(percent: int) -> str:
    """As _near, for rows that carry true sizes and wide sketches as well."""
    flips = "aggregate(zip_with(x.wide, y.wide, (i, j) -> bit_count(i ^ j)), 0, (t, z) -> t + z)"
    return f"if({_near(percent)}, {flips} * {100 + percent} <= (x.n + y.n) * {100 - percent}, false)"


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Keys of late of the pairs (early, late) whose whole sets are similar; only sets of texts in pairs are moved."""
    pairs = cut(pairs)
    few = sets.join(small(cut(pairs.select(F.col("early").alias("key")).union(pairs.select("late")).distinct())), "key", "left_semi")
    both = pairs.join(few.toDF("early", "p"), "early").join(few.toDF("late", "q"), "late")
    shared = F.size(F.array_intersect("p", "q"))
    return both.where(100 * shared >= percent * (F.size("p") + F.size("q") - shared)).select(F.col("late").alias("key")).distinct()


def _later(lines: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Keys of the line texts to which an earlier one is similar."""
    total = classes.agg(F.sum("copies")).first()[0] or 0
    common = classes.where((F.col("copies") > total / COMMON) & (F.col("copies") > 1)).select("key", F.col("first").alias("only"))  # fewer than COMMON
    once = lines.join(F.broadcast(common), "key", "left").where("only is null or only = pos").drop("only")
    levels = _rarity(lines)
    index = _index(once, levels, percent)
    # First, entries that meet any that may be similar, once each, however many they meet; both sides read one exchange.
    x, y = index.alias("x"), index.alias("y")
    met = x.join(y, F.expr(f"{TOKEN.format('x')} = {TOKEN.format('y')} and x.key <> y.key and {_near(percent)}"), "left_semi").distinct()
    met = cut_table(met)
    firsts = cut(classes.join(small(cut(met.select("key").distinct())), "key", "left_semi").select("key", "first"))
    # Their sets, one row for each text.
    sets = _sets(lines.join(small(firsts.withColumnRenamed("first", "pos")), ["key", "pos"], "left_semi"), levels)
    sets = cut_table(sets.select("key", F.size("o").alias("n"), F.expr(_wide("o")).alias("wide"), "o"))
    # Long sets often pass the short sketch by chance; with the wide one, entries meet once more, and only near ones stay.
    facts = cut(firsts.join(sets.select("key", "n", "wide"), "key"))
    met = cut_table(met.join(facts, "key").withColumn("w", F.expr("shiftrightunsigned(c, 32)")))
    x, y = met.alias("x"), met.alias("y")
    met = cut_table(x.join(y, F.expr(f"x.w = y.w and x.key <> y.key and {_near_wide(percent)}"), "left_semi"))
    sets = sets.select("key", "o")
    # Then each line against the first line at its tokens, and what that leaves against the second: groups of copies of one line end here.
    settled, heads, rest = [], None, met
    for _ in range(ROUNDS):
        lead = rest if heads is None else rest.join(heads.select("w", F.col("h.first").alias("was")), "w").where("first > was")
        heads = cut_table(lead.groupBy("w").agg(F.min(F.struct("first", "key", "c", "s", "n", "wide")).alias("h")))
        x, y = heads.select("w", "h.*").alias("x"), rest.alias("y")
        pairs = x.join(y, F.expr(f"x.w = y.w and x.first < y.first and {_near_wide(percent)}")).select(F.col("x.key").alias("early"), F.col("y.key").alias("late")).distinct()
        settled.append(cut(_similar(pairs, sets, percent)))
        rest = rest.join(small(settled[-1]), "key", "left_anti")
    # Last, what no such line settled against every earlier one.
    x, y = met.alias("x"), cut_table(rest).alias("y")
    pairs = x.join(y, F.expr(f"x.w = y.w and x.first < y.first and {_near_wide(percent)}")).select(F.col("x.key").alias("early"), F.col("y.key").alias("late")).distinct()
    return reduce(DataFrame.union, [*settled, _similar(pairs, sets, percent)])


def similar_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(id, line) of each line of docs(id long, text) that an earlier line (by id, line) equals to Jaccard percent / 100 or more, as sets of words.

    Words are ordered by rarity; similar sets share one of their rarest words, and the sizes, the positions
    there and a sketch bound how similar they can be. Equal texts are one class, so copies make no pairs.
    Blank lines never match. Texts and words are known by 64-bit hashes. Null texts have no lines.
    """
    lines = _lines(docs)
    classes = cut_table(lines.groupBy("key").agg(F.min("pos").alias("first"), F.count("*").alias("copies")))
    gone = _later(lines, classes, percent).select("key", F.lit(None).alias("first"))
    # What has something to remove: classes of several lines, all but the first, and those that go whole.
    judged = classes.where("copies > 1").select("key", "first").union(gone).groupBy("key").agg(F.max("first").alias("first"), F.max(F.col("first").isNull()).alias("gone"))
    return lines.select("id", "line", "key").join(judged, "key").where(F.expr(f"gone or {PLACE} > first")).select("id", "line")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """docs with the later of similar lines taken out of the text, plus n_lines and n_removed.

    Null texts stay null with 0 lines; a text whose lines all go becomes empty; blank lines stay. Lines of one document
    count as well. Of rows with one id, one keeps its place; the others, and rows with null ids, come after all ids.
    All rows and columns stay, but columns named n_lines or n_removed are replaced. No rows give no rows.
    """
    docs, key, _ = keyed(docs, id_col)
    gone, out_id = fresh(docs, "_gone"), fresh(docs, "_id")
    d = docs.select(F.col(key).alias("id"), F.col(text_col).alias("text"))
    lost = cut(similar_lines(d, percent).groupBy("id").agg(F.collect_set("line").alias(gone)).withColumnRenamed("id", out_id))
    # Lists of few lines go to the texts; beyond that texts and lists are exchanged.
    rows, held = lost.agg(F.count("*"), F.sum(F.size(gone))).first()
    lost = F.broadcast(lost) if rows <= FEW and (held or 0) <= 4 * FEW else lost
    out = docs.join(lost, F.col(key) == F.col(out_id), "left").drop(out_id, key)
    lines = F.split(text_col, "\n")
    # Lines that stay are those not in the set: one pass over a sequence.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    new = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    counts = {"n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"), "n_removed": F.coalesce(F.size(gone), F.lit(0)).cast("long")}
    return out.withColumns({**counts, text_col: F.when(F.col(gone).isNotNull(), new).otherwise(F.col(text_col))}).drop(gone)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the text that is left (null for null), for all documents; see dedup_lines."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))
