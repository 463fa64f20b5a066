"""Near-miss clones: winnowed fingerprints with positions, chained along diagonals into spans, spans merged to families."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import file_name
from .cuts import cut, cut_table
from .graph import weak_components
from .joins import meet, spread

TOKEN = re.compile(r"\w+|[^\w\s]")
#: Tokens in a fingerprint; of so many neighbouring fingerprints the least is kept.
GRAM, WINNOW = 8, 12
#: Each fingerprint's first places, which all its other places are compared with.
ANCHORS = 8
#: Tokens between two fingerprints of one chain; by how much its diagonal may shift between them.
GAP, DRIFT = 40, 12
# Endings of files that look alike by their role, and path words of data that is a contract.
BOILERPLATE = [".router.", ".routes.", ".handlers."]
CONTRACT_WORDS = ["model", "models", "schema", "schemas", "contract", "contracts"]
# What marks a line of code as doing something.
CONTROL_FLOW = ["if ", "if(", "for ", "for(", "while ", "while(", "return", "=>", "function", "throw", "await ", "switch", "yield", "match ", "loop ", "?."]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def read_tokens(text: str, mode: str = "near_miss", keep: frozenset = frozenset()) -> tuple[list[str], list[int]]:
    """Tokens of a text and their lines, from 1. In mode renamed, names that are not to be kept are all one token, numbers another."""
    tokens, lines = [], []
    for k, line in enumerate(text.split("\n"), 1):
        found = TOKEN.findall(line)
        if mode == "renamed":
            found = [t if t in keep or not (t[0].isalnum() or t[0] == "_") else "0" if t[0].isdigit() else "x" for t in found]
        tokens += found
        lines += [k] * len(found)
    return tokens, lines


def winnow(hashes: np.ndarray, gram: int = GRAM, window: int = WINNOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and fingerprints kept of a row of token hashes: in each window of grams the least, the last of equals; at least one if there is a gram."""
    n = len(hashes) - gram + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = np.zeros(n, np.uint64)
    for j in range(gram):
        grams = grams * np.uint64(0x100000001B3) + hashes[j : j + n]
    grams = _mix(grams)
    size = min(window, n)
    # The last of equal values is the first of the reversed window.
    view = np.lib.stride_tricks.sliding_window_view(grams, size)[:, ::-1]
    at = np.unique(np.arange(n - size + 1) + size - 1 - view.argmin(1))
    return at, grams[at].view(np.int64)


def _hashed(words: dict, tokens: list[str]) -> np.ndarray:
    from zlib import crc32

    # Not set(tokens) - words.keys(): that goes through all words known, for each text.
    fresh = {t for t in set(tokens) if t not in words}
    if len(words) > 1_000_000:
        words.clear()
        fresh = set(tokens)
    words.update({t: crc32(t.encode("utf-8", "replace")) | crc32(b"\0" + t.encode("utf-8", "replace")) << 32 for t in fresh})
    return np.array([words[t] for t in tokens], np.uint64)


#: Tokens that a task gathers before it passes them on.
BATCH = 500_000


def _read(mode: str, keep: frozenset):
    """For each document its token hashes and lines, whole, and its fingerprints."""
    names = ["id", "tokens", "lines", "at", "seeds"]

    def run(batches):
        words: dict = {}
        for pdf in batches:
            out, held = [], 0
            for own, text in zip(pdf["id"].tolist(), pdf["text"].tolist()):
                tokens, lines = read_tokens(text, mode, keep)
                hashes = _hashed(words, tokens)
                at, seeds = winnow(_mix(hashes))
                out.append((own, hashes.view(np.int64), np.array(lines, np.int32), at.astype(np.int32), seeds))
                held += len(tokens)
                if held >= BATCH:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=names)

    return run


def edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two rows of tokens, or most + 1 if it is over most.

    A column of the table is two whole numbers, the bits of its steps up and down (Myers 1999), so that a token costs a few operations on them.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    shared = min(len(a), len(b))
    unlike = np.flatnonzero(a[:shared] != b[:shared])
    head = int(unlike[0]) if len(unlike) else shared
    a, b = a[head:], b[head:]
    shared = min(len(a), len(b))
    unlike = np.flatnonzero(a[len(a) - shared :][::-1] != b[len(b) - shared :][::-1])
    tail = int(unlike[0]) if len(unlike) else shared
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    n, at = len(a), {}
    for i, x in enumerate(a):
        at.setdefault(x, []).append(i)
    bits = {}
    for x in at.keys() & set(b):
        held = bytearray((n + 7) // 8)
        for i in at[x]:
            held[i >> 3] |= 1 << (i & 7)
        bits[x] = int.from_bytes(held, "little")
    mask, top = (1 << n) - 1, n - 1
    up, down, score, left = mask, 0, n, len(b)
    for x in b:
        eq, left = bits.get(x, 0), left - 1
        over = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (mask & ~(over | up)), up & over
        score += (plus >> top & 1) - (minus >> top & 1)
        if score - left > most:
            return most + 1
        plus, eq = (plus << 1 | 1) & mask, eq | down
        up, down = (minus << 1 | ~(eq | plus)) & mask, plus & eq
    return score


def whole_lines(lines: np.ndarray, start: int, end: int) -> tuple[int, int]:
    """First and last line that tokens start to end (not included) cover wholly; those they touch, if they cover none."""
    first, last = int(lines[start]), int(lines[end - 1])
    low = first + bool(start and lines[start - 1] == first)
    high = last - bool(end < len(lines) and lines[end] == last)
    return (low, high) if low <= high else (first, last)


def _verify(min_tokens: int, permille: int):
    """Chains with the tokens and lines around them: grown while tokens agree, then measured."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                a, b = np.asarray(r.a_tokens), np.asarray(r.b_tokens)
                s, t, e, f = r.a_start - r.a_from, r.b_start - r.b_from, r.a_end - r.a_from, r.b_end - r.b_from
                # No fingerprint is farther than a window, so neither is the end of what agrees.
                for _ in range(WINNOW):
                    if s and t and a[s - 1] == b[t - 1]:
                        s, t = s - 1, t - 1
                for _ in range(WINNOW):
                    if e < len(a) and f < len(b) and a[e] == b[f]:
                        e, f = e + 1, f + 1
                parts = [(s, e, t, f)]
                if permille == 1000:  # one diagonal: the stretches that agree
                    size = min(e - s, f - t)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], (a[s : s + size] == b[t : t + size]).astype(np.int8), [0]]))).tolist()
                    parts = [(s + x, s + y, t + x, t + y) for x, y in zip(edge[::2], edge[1::2])]
                for s, e, t, f in parts:
                    if min(e - s, f - t) < min_tokens or (r.id == r.other and r.b_from + f > r.a_from + s):  # places that overlap are no copies of each other
                        continue
                    compared = max(e - s, f - t)
                    distance = edits(a[s:e], b[t:f], compared - -(-compared * permille // 1000))
                    alike = (compared - distance) * 1000 // compared
                    if alike >= permille:
                        out.append((r.id, *whole_lines(np.asarray(r.a_lines), s, e), r.other, *whole_lines(np.asarray(r.b_lines), t, f), compared, distance, alike))
            yield pd.DataFrame(out, columns=PAIR_NAMES)

    return run


PAIRS = "id string, start_line int, end_line int, other string, other_start int, other_end int, compared int, edits int, permille int"
PAIR_NAMES = [c.split(" ")[0] for c in PAIRS.split(", ")]


def chains(seeds: DataFrame, gap: int = GAP, drift: int = DRIFT) -> DataFrame:
    """(id, other, a_start, a_end, b_start, b_end): runs of shared fingerprints of seeds(id, at, seed).

    Each place of a fingerprint meets its first ANCHORS places, by id and position, that come before it: rows grow with places,
    not with their square. Matches on one diagonal with gaps of up to gap tokens are a run; runs whose diagonals lie within
    drift, gap or less apart, are a chain.
    """
    counts = seeds.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1")
    first = F.row_number().over(Window.partitionBy("seed").orderBy("id", "at"))
    anchors = seeds.withColumn("r", first).where(F.col("r") <= ANCHORS).drop("r").join(counts, "seed")
    m = meet(seeds, cut(anchors.select("seed", F.col("id").alias("other"), F.col("at").alias("b"), "n")), "seed", "n").withColumnRenamed("at", "a")
    m = m.where((F.col("other") < F.col("id")) | ((F.col("other") == F.col("id")) & (F.col("b") + GRAM <= F.col("a")))).withColumn("d", F.col("a") - F.col("b"))
    on = Window.partitionBy("id", "other", "d").orderBy("a")
    m = m.withColumn("far", (F.col("a") - F.lag("a").over(on) > gap).cast("int")).withColumn("k", F.sum(F.coalesce("far", F.lit(0))).over(on))
    runs = m.groupBy("id", "other", "d", "k").agg(F.min("a").alias("a_start"), (F.max("a") + GRAM).alias("a_end"))
    by = Window.partitionBy("id", "other").orderBy("a_start", "d")
    apart = (F.col("a_start") - F.max("a_end").over(by.rowsBetween(Window.unboundedPreceding, -1)) > gap) | (F.abs(F.col("d") - F.lag("d").over(by)) > drift)
    runs = runs.withColumn("far", apart.cast("int")).withColumn("c", F.sum(F.coalesce("far", F.lit(0))).over(by))
    return runs.groupBy("id", "other", "c").agg(
        F.min("a_start").alias("a_start"), F.max("a_end").alias("a_end"), F.min(F.col("a_start") - F.col("d")).alias("b_start"), F.max(F.col("a_end") - F.col("d")).alias("b_end"),
    ).drop("c")


def clone_pairs(docs: DataFrame, min_tokens: int = 50, min_similarity: float = 80, mode: str = "near_miss", keep: frozenset = frozenset()) -> DataFrame:
    """(id, start_line, end_line, other, other_start, other_end, compared, edits, permille): spans of docs(id, text) that are near copies.

    Modes: exact (no edits), renamed (names and numbers count as alike, but for those in keep), near_miss. min_similarity is a
    share of tokens, as a fraction or in percent: 1 - edits / tokens of the longer span. Spans are whole lines where they cover any.
    Texts are read whole, null ones are empty. Ids are compared as strings.
    """
    if mode not in ("exact", "renamed", "near_miss"):
        raise ValueError(f"no such mode: {mode}")
    permille = 1000 if mode != "near_miss" else round(min_similarity * (1000 if min_similarity <= 1 else 10))
    d = docs.select(F.col("id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    read = cut_table(d.mapInPandas(_read(mode, keep), "id string, tokens array<long>, lines array<int>, at array<int>, seeds array<long>"))
    seeds = cut_table(read.select("id", F.explode(F.arrays_zip("at", "seeds")).alias("s")).select("id", "s.at", F.col("s.seeds").alias("seed")))
    # What agrees beyond the outer fingerprints is under a window on each side.
    long = lambda x: F.col(f"{x}_end") - F.col(f"{x}_start") + 2 * WINNOW >= min_tokens
    found = chains(seeds) if permille < 1000 else chains(seeds, WINNOW, 0)
    found = cut_table(found.where(long("a") & long("b")))
    sides = (("a", "id"), ("b", "other"))
    for x, own in sides:
        around = F.greatest(F.col(f"{x}_start") - WINNOW - 1, F.lit(0))
        size = F.col(f"{x}_end") + WINNOW + 1 - around
        held = read.select(F.col("id").alias(own), F.col("tokens").alias("_t"), F.col("lines").alias("_l"))
        found = spread(found, held, own).withColumn(f"{x}_from", around).withColumns({f"{x}_tokens": F.slice("_t", around + 1, size), f"{x}_lines": F.slice("_l", around + 1, size)}).drop("_t", "_l")
    return found.mapInPandas(_verify(min_tokens, permille), PAIRS)


def families(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members(family, id, start_line, end_line) and families(family, members, documents, size) of clone pairs.

    Spans of one document that overlap are one member; a family is what pairs connect, named by its least member;
    its size is the sum of its members' lines. Pairs of several passes may be united before.
    """
    p = pairs.select("id", "start_line", "end_line", "other", "other_start", "other_end")
    spans = p.select("id", "start_line", "end_line").union(p.select("other", "other_start", "other_end")).distinct()
    by = Window.partitionBy("id").orderBy("start_line", "end_line")
    apart = F.col("start_line") > F.max("end_line").over(by.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("k", F.sum(F.when(apart, 1).otherwise(0)).over(by))
    merged = spans.withColumn("low", F.min("start_line").over(Window.partitionBy("id", "k"))).withColumn("high", F.max("end_line").over(Window.partitionBy("id", "k")))
    merged = cut(merged.select("id", "start_line", "end_line", "low", "high", F.concat_ws(":", "id", F.lpad(F.col("low").cast("string"), 10, "0")).alias("member")))
    a, b = merged.select("id", "start_line", "end_line", F.col("member").alias("src")), merged.select("id", "start_line", "end_line", F.col("member").alias("dst")).toDF("other", "other_start", "other_end", "dst")
    links = p.join(a, ["id", "start_line", "end_line"]).join(b, ["other", "other_start", "other_end"]).select("src", "dst")
    named = weak_components(links).withColumnRenamed("component", "family")
    members = cut(merged.select("id", F.col("low").alias("start_line"), F.col("high").alias("end_line"), F.col("member").alias("_m")).distinct().join(named.withColumnRenamed("id", "_m"), "_m").select("family", "id", "start_line", "end_line"))
    size = members.groupBy("family").agg(F.count("*").alias("members"), F.count_distinct("id").alias("documents"), F.sum(F.col("end_line") - F.col("start_line") + 1).cast("long").alias("size"))
    return members, size


def boilerplate(path: Column) -> Column:
    """Whether a file's name has the mark of a role whose files look alike."""
    name = F.lower(file_name(path))
    return F.exists(F.array(*map(F.lit, BOILERPLATE)), lambda m: F.contains(name, m))


def declarative(path: Column, text: Column) -> Column:
    """Whether lines only state data: none has control flow, and the path names no contract. No lines tell nothing."""
    contract = F.exists(F.split(F.lower(path), "[^a-z0-9]"), lambda w: w.isin(CONTRACT_WORDS))
    flow = F.exists(F.array(*map(F.lit, CONTROL_FLOW)), lambda m: F.contains(text, m))
    return (text != "") & ~contract & ~flow


def suppress(members: DataFrame, docs: DataFrame, include_boilerplate: bool = False, include_declarative: bool = True) -> DataFrame:
    """(family, reason) of families all of whose members are boilerplate, or declarative by their own lines; docs(id, path, text)."""
    lines = F.array_join(F.slice(F.split("text", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    m = members.join(docs.select(F.col("id").cast("string").alias("id"), "path", F.coalesce("text", F.lit("")).alias("text")), "id")
    m = m.select("family", boilerplate(F.col("path")).alias("b"), declarative(F.col("path"), lines).alias("d")).groupBy("family").agg(F.every("b").alias("b"), F.every("d").alias("d"))
    reason = F.when(F.col("b") & F.lit(not include_boilerplate), "boilerplate").when(F.col("d") & F.lit(not include_declarative), "declarative")
    return m.select("family", reason.alias("reason")).where("reason is not null")
