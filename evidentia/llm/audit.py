"""What each of five text filters removes alone, together and in every order: words as rows, failures as 32 counted masks."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_table, keyed, lookup, table, words_of

#: The filters, in the order of their bits in a mask.
LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
MASKS = range(2 ** len(LETTERS))
#: A text with fewer words fails A.
LEAST_WORDS = 200
#: A text with fewer distinct words, of a hundred, fails B.
LEAST_DISTINCT = 50
#: A text with more capitals, of a hundred code points, fails C.
MOST_CAPITALS = 3
#: A text with one of these fails D.
SYMBOLS = "[#$%&*|]"


def word_totals(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_words, n_distinct) of rows with words; key is unique.

    Texts are exchanged once, by key; a text's words then meet where it is, so neither aggregation exchanges again.
    """
    words = docs.select(key, text).repartition(key).select(key, F.explode(words_of(text)).alias("word")).where("word <> ''")
    return words.groupBy(key, "word").agg(F.count("*").alias("n")).groupBy(key).agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def filter_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, n_words, n_distinct, mask, copy_of) for each row of docs; the mask's bits are the failed filters, A the lowest.

    Null texts and parts are empty. E is failed by a row whose text a smaller id has as well, copy_of is the least of those
    (null else); a null id is smaller than none and has no smaller one. Repeated rows are judged each, and are no copies of
    each other. Other columns are left out. No rows give no rows.
    """
    d, key, _ = keyed(docs, id_col)
    d = d.select(F.col(key).alias("key"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    flags = d.select("key", "id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), (100 * capitals > MOST_CAPITALS * F.length("text")).alias("c"), F.col("text").rlike(SYMBOLS).alias("d"))
    none = F.lit(0).cast("long")
    judged = flags.join(word_totals(d, "key", "text"), "key", "left").withColumns({"n_words": F.coalesce("n_words", none), "n_distinct": F.coalesce("n_distinct", none)})
    judged = cut_table(judged.withColumns({"a": F.col("n_words") < LEAST_WORDS, "b": 100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words")}).drop("key"))
    firsts = cut(judged.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    j = lookup(judged, firsts, "digest", "n")
    j = j.withColumn("e", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))
    mask = sum((F.col(x.lower()).cast("int") * 2**k for k, x in enumerate(LETTERS)), F.lit(0))
    return j.select("id", "part", "n_words", "n_distinct", mask.alias("mask"), F.when(F.col("e"), F.col("first")).alias("copy_of"))


def mask_counts(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, n, good, toxic): for each part arrays of 32 counts by mask: of rows, of good and of toxic ones.

    labels(doc_id, quality, toxic): an id is good if one of its rows has quality 1, toxic if one has toxic 1; null ids are neither.
    """
    # Counted by id before labels meet them, so that an id of very many rows is few rows there.
    by_id = flags.groupBy("id", "part", "mask").agg(F.count("*").alias("k"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    j = by_id.join(known, "id", "left")
    count = lambda m, more: F.coalesce(F.sum(F.when((F.col("mask") == m) & more, F.col("k"))), F.lit(0).cast("long"))
    cols = {"n": F.lit(True), "good": F.col("good") == 1, "toxic": F.col("toxic") == 1}
    flat = j.groupBy("part").agg(*[count(m, more).alias(f"{name}{m}") for name, more in cols.items() for m in MASKS])
    return flat.select("part", *[F.array(*[f"{name}{m}" for m in MASKS]).alias(name) for name in cols])


def _total(counts: str, holds) -> Column:
    """The sum of the counts whose mask holds()."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(MASKS) - 1)), F.lit(0).cast("long"), lambda t, m: t + F.when(holds(m), F.element_at(counts, m + 1)).otherwise(F.lit(0)))


def order_report(counts: DataFrame) -> DataFrame:
    """What each step of all orders does to each part of mask_counts(): five rows for each part and order.

    A filter's shapley is the sum of what it removes over all orders: of a mask of k bits, each bit comes first in one k-th of them.
    """
    rows = counts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(ORDERS)), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    done = F.expr("substring(filter_order, 1, step - 1)")
    before = sum((F.when(F.contains(done, F.lit(x)), 2**k).otherwise(0) for k, x in enumerate(LETTERS)), F.lit(0))
    own = sum((F.when(F.expr("substring(filter_order, step, 1)") == x, 2**k).otherwise(0) for k, x in enumerate(LETTERS)), F.lit(0))
    rows = rows.withColumns({"before": before, "own": own})
    both = lambda m, c: m.bitwiseAND(F.col(c)) != 0
    now = lambda m: both(m, "own") & ~both(m, "before")
    #: Orders in which a given one of a mask's bits comes first.
    leading = lambda m: F.element_at(F.array(*[F.lit(len(ORDERS) // max(1, m.bit_count())).cast("long") for m in MASKS]), m + 1)
    share = F.aggregate(F.sequence(F.lit(0), F.lit(len(MASKS) - 1)), F.lit(0).cast("long"), lambda t, m: t + F.when(both(m, "own"), F.element_at("n", m + 1) * leading(m)).otherwise(F.lit(0)))
    return rows.select(
        "part", "filter_order", "step", _total("n", lambda m: ~both(m, "own") & ~both(m, "before")).alias("kept"), _total("n", now).alias("removed"),
        _total("n", lambda m: both(m, "own") & both(m, "before")).alias("redundant"), _total("n", lambda m: m == F.col("own")).alias("unique_fails"),
        _total("good", now).alias("good_lost"), _total("toxic", now).alias("toxic_lost"), share.alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """part, filter_order, step and what the step does, over all documents; see order_report."""
    return order_report(mask_counts(filter_flags(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


_BITS = " + ".join(f"CASE WHEN {x} THEN {2**k} ELSE 0 END" for k, x in enumerate("abcde"))
_HIT = lambda bits: f"(mask & {bits}) <> 0"
_BEFORE = " + ".join(f"CASE WHEN contains(substring(filter_order, 1, step - 1), '{x}') THEN {2**k} ELSE 0 END" for k, x in enumerate(LETTERS))
_OWN = " + ".join(f"CASE WHEN substring(filter_order, step, 1) = '{x}' THEN {2**k} ELSE 0 END" for k, x in enumerate(LETTERS))
ORACLE = {
    "op11_filter_audit": f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.doc_id, part, len(words) < {LEAST_WORDS} AS a, 100 * list_unique(words) < {LEAST_DISTINCT} * len(words) AS b, 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > {MOST_CAPITALS} * length(text) AS c,
  regexp_matches(text, '{SYMBOLS}') AS d, w.doc_id > min(w.doc_id) OVER (PARTITION BY text) AS e FROM w),
m AS (SELECT part, {_BITS} AS mask, count(*) AS n, count_if(coalesce(good, false)) AS good, count_if(coalesce(toxic, false)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
o AS (SELECT filter_order, step, {_BEFORE} AS before, {_OWN} AS own FROM (SELECT unnest([{', '.join(f"'{o}'" for o in ORDERS)}]) AS filter_order), (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN {_HIT('(own | before)')} THEN 0 ELSE n END) AS kept, sum(CASE WHEN {_HIT('own')} AND NOT {_HIT('before')} THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN {_HIT('own')} AND {_HIT('before')} THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN {_HIT('own')} AND NOT {_HIT('before')} THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN {_HIT('own')} AND NOT {_HIT('before')} THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, o GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""",
}
