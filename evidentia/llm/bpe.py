"""Byte-level BPE by a pair occurrence index."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Fixed value: how byte-level BPE vocabularies cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters beyond two bytes; texts without them are cut by Python's own patterns, which take half the time.
ASTRAL = re.compile("[\U00010000-\U0010ffff]")
#: Words remembered per task; beyond it only those that are in use stay.
REMEMBER = 150_000
#: Characters of text that are cut and encoded together.
PIECE = 4_000_000
#: Lists of places shorter than this, on average, are merged place by place.
LIST = 4


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}


def _class(name: str) -> str:
    """The characters of two bytes that a class of regex's has, as ranges of a set in Python's patterns."""
    runs = regex.finditer(f"{name}+", "".join(map(chr, range(1 << 16))))
    return "".join(f"\\u{m.start():04x}-\\u{m.end() - 1:04x}" for m in runs)


@lru_cache(maxsize=1)
def _plain_words() -> re.Pattern:
    """WORDS for texts of characters of two bytes."""
    letters, numbers, blanks = _class(r"\p{L}"), _class(r"\p{N}"), _class(r"\s")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{blanks}{letters}{numbers}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+")


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in letters.items()}
        self.bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        #: The id of each byte; no text holds byte 255, so it ends words.
        self.first = np.array([vocab[letters[b]] for b in range(255)] + [-1], np.int64)
        #: (left id, right id) -> (rank, merged id)
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.pairs = [(a, b, new) for (a, b), (_, new) in sorted(self.merges.items(), key=lambda m: m[1])]
        #: The pairs in order of their codes, and the rank of each.
        code = np.array([a << 32 | b for a, b, _ in self.pairs], np.int64)
        self.rank_of = np.argsort(code)
        self.codes = code[self.rank_of]
        self.ranks = sorted(rank for rank, _ in self.merges.values())
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words, self.plain_words = regex.compile(WORDS), _plain_words()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair among the ranks, -1 if it never merges."""
        code = (left << 32) | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.codes[at] == code), self.rank_of[at], -1)

    def cut(self, text: str) -> list[str]:
        """Words in order; a special token is a one-tuple."""
        words = self.words if ASTRAL.search(text) else self.plain_words
        if not self.split or not self.split.search(text):
            return words.findall(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += words.findall(text[at : m.start()])
            out.append((m.group(),))
            at = m.end()
        return out + words.findall(text[at:])

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word. All words lie in one chain; ranks are applied in ascending order to all of a pair's places.

        Long lists of places are merged as arrays; once lists are short, as the later ranks' are, place by place.
        """
        if not words or not len(self.codes):
            return [tuple(self.first[np.frombuffer(w.encode("utf-8", "replace"), np.uint8)].tolist()) for w in words]
        ids = self.first[np.frombuffer(b"\xff".join(w.encode("utf-8", "replace") for w in words) + b"\xff", np.uint8)]
        n = len(ids)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        places: dict[int, list[int]] = {}
        queue: list[int] = []

        def note(rank: np.ndarray, at: np.ndarray) -> None:
            """Add places to their pairs' lists."""
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            ends = np.flatnonzero(np.diff(rank, append=-1)) + 1
            start = 0
            for end in ends.tolist():
                r = int(rank[end - 1])
                if r not in places:
                    places[r] = []
                    heapq.heappush(queue, r)
                places[r] += at[start:end].tolist()
                start = end

        found = self.rank(ids[:-1], ids[1:])
        at = np.flatnonzero(found >= 0)
        note(found[at], at)
        length = 100.0  # of late lists, on average
        while queue and length > LIST:
            r = heapq.heappop(queue)
            a, b, new = self.pairs[r]
            i = np.unique(np.array(places.pop(r), np.int64))
            length = 0.95 * length + 0.05 * len(i)
            i = i[ids[i] == a]
            i = i[ids[nxt[i]] == b]
            if a == b and len(i) > 1:  # runs like "aaa" merge from the left, every second place
                at = np.arange(len(i))
                begins = np.concatenate([[True], nxt[i[:-1]] != i[1:]])
                i = i[(at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 0]
            if not len(i):
                continue
            j = nxt[i]
            k = nxt[j]  # at least the word's end
            ids[i], ids[j] = new, -2
            nxt[i], prv[k] = k, i
            h = prv[i]
            lefts, rights = np.where(h >= 0, ids[h], -1), ids[nxt[i]]
            both = self.rank(np.concatenate([lefts, np.full(len(i), new)]), np.concatenate([np.full(len(i), new), rights]))
            live = both >= 0
            note(both[live], np.concatenate([h, i])[live])
        ids, nxt, prv = ids.tolist(), nxt.tolist(), prv.tolist()
        merges, ranks = self.merges, {r: k for k, r in enumerate(self.ranks)}
        while queue:
            r = heapq.heappop(queue)
            a, b, new = self.pairs[r]
            for i in sorted(places.pop(r)):
                if ids[i] != a:
                    continue
                j = nxt[i]
                if ids[j] != b:
                    continue
                k, h = nxt[j], prv[i]
                ids[i], ids[j] = new, -2
                nxt[i], prv[k] = k, i
                for at, two in ((h, (ids[h] if h >= 0 else -1, new)), (i, (new, ids[k]))):
                    if two in merges:
                        q = ranks[merges[two][0]]
                        if q not in places:
                            places[q] = []
                            heapq.heappush(queue, q)
                        places[q].append(at)
        # What is left, in order: merged-away places are -2, ends of words -1.
        out, word = [], []
        for x in ids:
            if x >= 0:
                word.append(x)
            elif x == -1:
                out.append(tuple(word))
                word = []
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_texts(bpe: ByteBpe, texts: list[str], memory: dict, keep) -> list[list]:
    """The words of each text; memory (word -> what keep makes of its ids) then holds all of them."""
    cuts = [bpe.cut(t) for t in texts]
    used = set().union(*cuts)
    if len(memory) > REMEMBER:
        for w in memory.keys() - used:
            del memory[w]
    fresh = list(used - memory.keys())
    plain = [w for w in fresh if isinstance(w, str)]
    memory.update(zip(plain, map(keep, bpe.encode_words(plain))))
    memory.update({w: keep((bpe.special[w[0]],)) for w in fresh if not isinstance(w, str)})
    return cuts


def _pieces(texts: list[str], size: int = PIECE):
    """The texts in lots of about size characters, so that what a lot needs stays small."""
    lot, held = [], 0
    for t in texts:
        lot.append(t)
        held += len(t)
        if held >= size:
            yield lot
            lot, held = [], 0
    if lot:
        yield lot


def _encoded(bpe: ByteBpe, batches, keep=lambda ids: ids):
    """Lots of each batch: the rows' ids and, for each text, what keep makes of each of its words' token ids."""
    memory: dict = {}
    for pdf in batches:
        at = 0
        for lot in _pieces(pdf["text"].tolist()):
            cuts = encode_texts(bpe, lot, memory, keep)
            yield pdf["id"].iloc[at : at + len(lot)].tolist(), [list(map(memory.__getitem__, c)) for c in cuts]
            at += len(lot)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id and text's ids array<int>. Null and empty texts give no ids; other columns are left out, repeated rows stay.

    Texts are read whole, in lots of about PIECE characters. Null ids stay null. No rows give no rows.
    """

    def run(batches):
        for own, texts in _encoded(load(path), batches):
            yield pd.DataFrame({"id": own, "ids": [list(chain.from_iterable(t)) for t in texts]})

    out = _texts(docs, id_col, text_col).mapInPandas(run, "id string, ids array<int>")
    return out.select(F.col("id").cast("long").alias(id_col), "ids")


def digest_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As tokenize(), but count and digest of the ids, and digest of the text decoded from them, so that no ids leave the task."""

    def run(batches):
        bpe = load(path)
        # Of each word its number of ids, their digits and the bytes that they decode to.
        word = lambda ids: (len(ids), ",".join(map(str, ids)), b"".join(map(bpe.bytes.__getitem__, ids)))
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for own, texts in _encoded(bpe, batches, word):
            yield pd.DataFrame({
                "id": own, "n_tokens": [sum([w[0] for w in t]) for t in texts], "ids_sha256": [sha(",".join([w[1] for w in t]).encode()) for t in texts],
                "decoded_sha256": [sha(b"".join([w[2] for w in t]).decode("utf-8", "replace").encode()) for t in texts],
            })

    out = _texts(docs, id_col, text_col).mapInPandas(run, "id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select(F.col("id").cast("long").alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256")


def op7_bpe_tokens(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text of all documents; see digest_tokens."""
    import public_tokenizers

    return digest_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
