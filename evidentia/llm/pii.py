"""Personal data: base patterns plus information-theoretic sanitisation, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_table, fresh, keyed, small, table

#: Starts at a run's first character or where the last match ended, so long runs are scanned once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A run of letters, marks and digits of any script, whole.
TERM = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*+"
#: Stands for a span that is taken out; words that touch it are no whole words.
HOLE = "\uffff"
FREE = rf"(?<![\p{{L}}\p{{M}}\p{{N}}{HOLE}]){TERM}(?!{HOLE})"
#: A match's stand-in when text is rewritten.
TAGS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "secret": "<SECRET>", "term": "<TERM>"}
#: Keys and tokens: whole runs of letters and digits that no word is like.
SECRET = r"(?<![A-Za-z0-9+=])(?=[A-Za-z+=]*+[0-9])(?=[0-9+=]*+[A-Za-z])[A-Za-z0-9+=]{24,}+"
#: Terms are first tried against a table of this many hash slots, a bit each, whatever their number.
SLOTS = 65_536
#: Arrays are summed in blocks of this many.
BLOCK = 256
#: Terms are counted over one in so many texts first: all terms in the first lot, which so grows as the texts do, then those that it does
#: not rule out in the second; all terms that neither rules out are counted over all texts.
PARTS = (64, 16)


def _let(value: Column, body) -> Column:
    """body(value), with value made once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _running(lengths: Column) -> Column:
    """For each of lengths the sum of those before it; in blocks, since each append copies what it appends to."""
    ints, lists = F.array().cast("array<int>"), F.array().cast("array<array<int>>")
    add = lambda b, at: F.aggregate(b, F.struct(at.alias("at"), ints.alias("out")), lambda c, x: F.struct((c["at"] + x).alias("at"), F.concat(c["out"], F.array(c["at"])).alias("out")))
    step = lambda a, b: _let(add(b, a["at"]), lambda c: F.struct(c["at"].alias("at"), F.concat(a["out"], F.array(c["out"])).alias("out")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda c: F.slice(lengths, c * BLOCK + 1, BLOCK))
    return F.when(F.size(lengths) > 0, F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), lists.alias("out")), step, lambda a: a["out"]))).otherwise(ints)


def _found(text: Column, pattern: str, guard: Column) -> Column:
    """array<struct<s,m>>: all matches (start in code points, matched text), leftmost and not overlapping."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    both = F.struct(gaps.alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def place(b: Column) -> Column:
        sums = _let(F.zip_with(F.slice(b["g"], 1, F.size(b["m"])), b["m"], lambda g, m: g + F.length(m)), _running)
        return F.transform(F.arrays_zip(sums.alias("r"), b["g"].alias("g"), b["m"].alias("m")), lambda x: F.struct((x["r"] + x["g"]).alias("s"), x["m"].alias("m")))

    # There is one gap more than matches.
    return F.when(guard, F.filter(_let(both, place), lambda x: x["m"].isNotNull())).otherwise(F.array().cast("array<struct<s:int,m:string>>"))


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """array<struct<kind,start,end,value>> by kind (email, ip, card, phone, secret), then start."""
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255")
    ok = {
        "email": lambda m: F.lit(True),
        "ip": lambda m: F.forall(F.split(m, r"\."), part),
        # The length is settled before a digit is read, so long runs of digits cost nothing more.
        "card": lambda m: F.when(F.length(digits(m)).between(16, 19), _luhn(digits(m))).otherwise(False),
        "phone": lambda m: F.length(digits(m)).between(8, 15),
    }
    guards = {
        "email": (EMAIL, F.contains(text, F.lit("@"))),
        "ip": (IP, text.rlike(r"[0-9]\.[0-9]")),
        # Only sixteen digits or more can pass; texts without them need no list of their numbers.
        "card": (CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")),
        "phone": (PHONE, F.contains(text, F.lit("+"))),
    }
    found = []
    for kind, (pattern, guard) in guards.items():
        good = F.filter(_found(text, pattern, guard), lambda x: ok[kind](x["m"]))
        found.append(F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("start"), (x["s"] + F.length(x["m"])).alias("end"), x["m"].alias("value"))))
    # Beside the four kinds and outside their spans: secrets, runs with too many kinds of characters and digits to be words.
    mixed = lambda m: (F.length(F.regexp_replace(m, "[^0-9]", "")) >= 4) & (F.size(F.array_distinct(F.split(m, ""))) >= 10)
    secret = F.transform(F.filter(_found(text, SECRET, text.rlike("[A-Za-z0-9+=]{24}")), lambda x: mixed(x["m"])), lambda x: F.struct(F.lit("secret").alias("kind"), x["s"].alias("start"), (x["s"] + F.length(x["m"])).alias("end"), x["m"].alias("value")))
    return _let(F.concat(*found), lambda base: F.concat(base, F.filter(secret, lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"])))))


def _words(text: Column, pattern: str = TERM) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)))


def _pieces(spans: Column) -> Column:
    """Of spans sorted by start, which may overlap, those that begin after what came before: (from, start, end, kind), from being where that ended."""
    none = F.array().cast("array<struct<from:int,start:int,end:int,kind:string>>")
    add = lambda a, x: F.when(x["start"] < a["at"], F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out"))).otherwise(
        F.struct(x["end"].alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("from"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))).alias("out"))
    )
    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), none.alias("out")), add)


def _replaced(text: Column, spans: Column, tag) -> Column:
    """text with tag(kind) in place of each of spans; overlapping ones become the first one's tag."""
    by_start = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("far"), x["kind"].alias("kind"), x["end"].alias("end"))))

    def build(a: Column) -> Column:
        # What lies between a piece and the next lies after the piece's last overlapping span, which is where the next one's from is.
        head = F.transform(a["out"], lambda x: F.concat(F.substring(text, x["from"] + 1, x["start"] - x["from"]), tag(x["kind"])))
        return F.concat(F.array_join(head, ""), F.substring(text, a["at"] + 1, F.length(text)))

    return _let(_pieces(by_start), build)


def _entities(span: Column) -> Column:
    """What a span discloses: that there is such data, its issuer (domain, network, first digits), and the value itself."""
    kind, value = span["kind"], F.lower(span["value"])
    digits = F.regexp_replace(value, "[^0-9]", "")
    part = (
        F.when(kind == "email", F.regexp_extract(value, "@(.*)$", 1)).when(kind == "ip", F.regexp_extract(value, r"^([0-9]+\.[0-9]+\.[0-9]+)", 1))
        .when(kind == "card", F.substring(digits, 1, 6)).when(kind == "phone", F.substring(digits, 1, 4))
    )
    return F.filter(F.array(kind, F.concat_ws(":", kind, part), F.concat_ws("=", kind, value)), lambda e: ~e.endswith(":"))


def disclosing_terms(docs: DataFrame, found: DataFrame, min_support: int = 3, disclosure: float = 0.9) -> DataFrame:
    """Terms (words of any length and script) that reveal a protected entity, from counts over all of docs(id, text).

    found(id, h, text, spans) has docs' rows with the text's hash h, and the text itself where it has spans. A span's kind,
    its issuer and its value are entities. Entity e has information IC(e) = -log2(N_e / N), term t reveals
    PMI(e, t) = log2(N * N_et / (N_e * N_t)) of it; t discloses e from PMI >= disclosure * IC(e) on. N counts distinct texts,
    so copies add no evidence, N_et those that hold e and, outside of all spans, t, however far apart. Both must stand in
    min_support texts, or log2(N) / 2 if that is more, as rare terms meet by chance.

    PMI >= disclosure * IC is N_t <= N_et * (N / N_e)^(1 - disclosure). Counts over part of the texts (those with spans, then one
    in PARTS of all) are no more than N_t, so terms that cannot pass go before N_t itself is counted; none that can is lost.
    """
    none = docs.select(F.lit("").alias("term")).limit(0)
    size = found.agg(F.count_distinct("h")).first()[0]
    support = max(min_support, math.ceil(math.log2(max(1, size)) / 2))
    held = cut_table(found.where(F.size("spans") > 0).select("h", "text", "spans").dropDuplicates(["h"]))
    ents = held.select("h", F.explode("spans").alias("e")).select("h", F.explode(_entities(F.col("e"))).alias("entity")).distinct()
    ents = cut(ents)
    n_e = ents.groupBy("entity").agg(F.count("*").alias("n_e")).where((F.col("n_e") >= support) & (F.col("n_e") < size))
    at = cut(ents.join(n_e, "entity"))
    if at.isEmpty():
        return none
    around = held.select("h", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(_replaced(F.col("text"), F.col("spans"), lambda k: F.lit(HOLE))), F.lit(FREE), F.lit(0)))).alias("term"))
    around = cut_table(around)
    # One row a text, entity and term, counted where it is made.
    n_et = around.join(at, "h").groupBy("entity", "term").agg(F.count("*").alias("n_et"), F.first("n_e").alias("n_e")).where(F.col("n_et") >= support)
    most = F.col("n_et") * F.pow(F.lit(float(size)) / F.col("n_e"), F.lit(1 - disclosure)) * (1 + 1e-9)
    near = around.groupBy("term").agg(F.count("*").alias("n_near")).where(F.col("n_near") >= support)
    pairs = cut(n_et.withColumn("most", most).join(near, "term").where("n_near <= most").drop("n_near"))
    h = F.xxhash64("text")
    words = lambda texts, terms: texts.select(h.alias("h"), F.explode(terms).alias("term")).distinct()
    for part in PARTS:
        listed = _words(F.col("text"))
        # A common word is a candidate beside many entities, so candidates in the first lot would be rows beyond the texts' growth.
        terms = listed if part == PARTS[0] else F.filter(listed, _slots(pairs.select("term")))
        some = words(docs.where(F.pmod(h, F.lit(part)) == 0), terms).groupBy("term").agg(F.count("*").alias("n_some"))
        pairs = cut(pairs.join(some, "term", "left").where("n_some is null or n_some <= most").drop("n_some"))
    words = words(docs, F.filter(_words(F.col("text")), _slots(pairs.select("term"))))
    n_t = words.groupBy("term").agg(F.count("*").alias("n_t"))
    pmi, ic = F.log2(size * F.col("n_et") / (F.col("n_e") * F.col("n_t"))), -F.log2(F.col("n_e") / size)
    return pairs.join(n_t, "term").where(pmi >= disclosure * ic).select("term").distinct()


def _slots(terms: DataFrame):
    """A filter that passes all of terms and few others: SLOTS bits by hash, collected as longs."""
    slot = lambda c: F.xxhash64(c).bitwiseAND(SLOTS - 1)
    rows = terms.select(slot(F.col("term")).alias("k")).distinct().groupBy(F.expr("k div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(k % 64 as int)))").alias("bits")).collect()
    on = {r["at"]: r["bits"] for r in rows}
    bits = F.split(F.lit(",".join(str(on.get(i, 0)) for i in range(SLOTS // 64))), ",").cast("array<long>")
    has = lambda k: F.call_function("shiftright", F.get(bits, F.shiftright(k, 6).cast("int")), k.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    return (lambda w: has(slot(w))) if on else (lambda w: F.lit(False))


def _spans(docs: DataFrame, text_col: str, key: str, own: str, limits: dict) -> DataFrame:
    """(id, own, spans) of all rows of docs, by their key."""
    d = docs.select(F.col(key).alias("id"), F.col(own).cast("long").alias("own"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The patterns run once; only texts with spans are kept beside them.
    found = d.select("id", "own", F.xxhash64("text").alias("h"), "text", F.explode(F.array(base_spans(F.col("text")))).alias("spans"))
    found = cut_table(found.withColumn("text", F.when(F.size("spans") > 0, F.col("text"))))
    terms = cut(disclosing_terms(d, found, **limits))
    slots = _slots(terms)
    held = d.select("id", F.explode(F.filter(_words(F.col("text")), slots)).alias("term")).join(terms, "term").groupBy("id").agg(F.collect_set("term").alias("terms"))
    marked = d.join(small(cut(held), 50_000), "id").select("id", "terms", F.explode(F.array(_found(F.col("text"), TERM, F.lit(True)))).alias("w"))
    one = marked.select("id", F.explode(F.filter("w", lambda x: F.array_contains("terms", F.lower(x["m"])))).alias("w")).select("id", F.col("w.s").alias("s"), (F.col("w.s") + F.length("w.m")).alias("e"))
    extra = one.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.lit("term").alias("kind"), F.col("s").alias("start"), F.col("e").alias("end")))).alias("extra"))
    out = found.select("id", "own", F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("base")).join(cut(extra), "id", "left")
    free = F.filter("extra", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"])))
    return out.select("id", "own", F.concat("base", F.coalesce(free, F.array().cast("array<struct<kind:string,start:int,end:int>>"))).alias("spans"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """id and spans array<struct<kind,start,end>>: base spans, secrets, then disclosing terms (kind term) outside them.

    One row for each of docs, repeated and null ids too. Null texts are empty and, like texts without personal
    data, have no spans; long texts are searched whole. Other columns are not read; no rows give no rows.
    """
    docs, key, _ = keyed(docs, id_col)
    return _spans(docs, text_col, key, id_col, limits).select(F.col("own").alias(id_col), "spans")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """docs with each span of its text generalised to its kind's tag; overlapping spans become the first one's tag.

    All rows and columns stay, whatever their names; null texts stay null. Repeated and null ids are rows of their own.
    """
    docs, key, _ = keyed(docs, id_col)
    out_id, spans = fresh(docs, "_id"), fresh(docs, "_spans")
    found = _spans(docs, text_col, key, id_col, limits).where(F.size("spans") > 0).select(F.col("id").alias(out_id), F.col("spans").alias(spans))
    tag = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])
    joined = docs.join(found, F.col(key) == F.col(out_id), "left")
    new = _replaced(F.col(text_col), F.col(spans), lambda k: tag[k])
    return joined.withColumn(text_col, F.when(F.col(spans).isNotNull(), new).otherwise(F.col(text_col))).drop(out_id, spans, key)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Counts by kind, a digest of the base spans and all spans, of all documents; see find_pii."""
    found = find_pii(table(spark, sf_dir, "documents"))
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: ~x["kind"].isin("secret", "term"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    kinds = map(count, ("email", "ip", "card", "phone", "secret", "term"))
    return found.select("doc_id", *kinds, F.size("spans").cast("long").alias("n_found"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
