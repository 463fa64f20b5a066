"""Exact token counts at every prefix of a text, by dynamic programming over byte-level BPE."""

from __future__ import annotations

from array import array
from functools import lru_cache
from itertools import chain, compress, islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import REMEMBER, ByteBpe, _pieces
from .common import mix, table

#: Contractions of three characters; cut after two, they are no contraction, but two words.
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")
#: A text with more tokens is over the limit.
LIMIT = 512
BLANK = regex.compile(r"\s+")
#: Words of at most so many bytes are counted TOGETHER, that many at once; longer ones one by one.
SHORT, TOGETHER = 48, 100_000
#: Places for remembered pairs of tokens; a power of two.
PAIRS = 1 << 20
#: Rank of a merge that never comes.
NEVER = 1 << 60


class Numbers(dict):
    """Word -> its number; a word that is asked for the first time gets the next one."""

    def __missing__(self, word) -> int:
        self[word] = n = len(self)
        return n


class PrefixBpe:
    """Token counts of all prefixes of words, each worked out once.

    A row of tokens is what BPE makes of its bytes if and only if each two neighbours are what it makes of theirs. So the
    last token of a prefix is the one token that ends there and stays apart from the last token of the prefix before it, and
    counts follow from shorter prefixes' counts. Needs a vocabulary in which every token comes from one merge of parts that
    come earlier, as trained ones are.
    """

    def __init__(self, path: str):
        self.bpe = ByteBpe(path)
        made: dict[int, tuple[int, int, int]] = {}
        for (a, b), (rank, new) in self.bpe.merges.items():
            if new in made:
                raise ValueError(f"token {new} comes from more than one merge")
            made[new] = (a, b, rank)
        if any(made.get(part, (0, 0, -1))[2] >= rank for a, b, rank in made.values() for part in (a, b)):
            raise ValueError("a merge comes before its parts'")
        self.rank = {pair: rank for pair, (rank, _) in self.bpe.merges.items()}
        #: Of each token its first (last) parts, from the whole to the byte, and the rank at which each goes up in the next larger.
        self.firsts = {t: self._parts(t, made, 0) for t in (*made, *self.bpe.first[:-1].tolist())}
        self.lasts = {t: self._parts(t, made, 1) for t in self.firsts}
        #: Tokens spelt backwards, as a tree: state << 8 | byte -> next state; the token that each state ends, or -1.
        self.back: dict[int, int] = {}
        ends = [-1]
        for t in self.firsts:
            state = 0
            for byte in reversed(self.bpe.bytes[t]):
                state = self.back.setdefault(state << 8 | byte, len(ends))
                if state == len(ends):
                    ends.append(-1)
            ends[state] = t
        self.ends = np.array(ends, np.int64)
        code = np.array(list(self.back), np.int64)
        order = np.argsort(code)
        self.codes, self.nexts = code[order], np.array(list(self.back.values()), np.int64)[order]
        #: Pairs that were asked for, each at one place, where a later one takes it.
        self.asked, self.answer = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.forget()

    @staticmethod
    def _parts(token: int, made: dict, side: int) -> list[tuple[int, int]]:
        out, until = [], NEVER
        while True:
            out.append((token, until))
            if token not in made:
                return out
            until, token = made[token][2], made[token][side]

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens as they are, side by side: no merge crosses while parts that could are there.

        Of equal merges the left one comes first: one that ends the left token's part comes before one that crosses, one in the right token after.
        """
        rank = self.rank
        for a, a_until in self.lasts[left]:
            for b, b_until in self.firsts[right]:
                r = rank.get((a, b))
                if r is not None and r < a_until and r <= b_until:
                    return False
        return True

    def all_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """stay_apart() of many pairs, remembered."""
        pair = left << 32 | right
        place = (mix(pair) & np.uint64(PAIRS - 1)).astype(np.int64)
        ok = self.answer[place]
        new = self.asked[place] != pair
        if new.any():
            some, of = np.unique(pair[new], return_inverse=True)
            told = np.array([self.stay_apart(p >> 32, p & 0xFFFFFFFF) for p in some.tolist()])
            ok[new] = told[of]
            # One write a place, so that a pair and its answer belong together.
            at, first = np.unique(place[new], return_index=True)
            self.asked[at], self.answer[at] = pair[new][first], told[of][first]
        return ok

    def _count_long(self, data: bytes) -> np.ndarray:
        """Counts of all prefixes of one word, byte by byte."""
        last, count = array("i", [-1]) * (len(data) + 1), array("i", [0]) * (len(data) + 1)
        back, ends, apart = self.back, self.ends.tolist(), {}
        for end in range(1, len(data) + 1):
            state, start, fits = 0, end, []
            while start:
                state = back.get(state << 8 | data[start - 1])
                if state is None:
                    break
                start -= 1
                if ends[state] >= 0:
                    fits.append((start, ends[state]))
            for start, token in reversed(fits):
                pair = (last[start], token)
                ok = apart.get(pair)
                if ok is None:
                    ok = apart[pair] = not start or self.stay_apart(*pair)
                if ok:
                    last[end], count[end] = token, count[start] + 1
                    break
        return np.frombuffer(count, np.int32)[1:]

    def _count_short(self, words: list[bytes]) -> np.ndarray:
        """The same for words in order of falling length, one after the other: all words' first bytes at once, then their second ones, and so on."""
        sizes = np.array([len(w) for w in words])
        wide = int(sizes[0])
        inside = np.arange(wide) < sizes[:, None]
        data = np.zeros(inside.shape, np.int64)
        data[inside] = np.frombuffer(b"".join(words), np.uint8)
        last, count = np.full((len(words), wide + 1), -1, np.int64), np.zeros((len(words), wide + 1), np.int32)
        for end in range(1, wide + 1):
            rows = np.arange(np.searchsorted(-sizes, -end, side="right"))
            state, fits = np.zeros(len(rows), np.int64), []
            for start in range(end - 1, -1, -1):
                code = state << 8 | data[rows, start]
                at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                there = self.codes[at] == code
                rows, state = rows[there], self.nexts[at[there]]
                if not len(rows):
                    break
                token = self.ends[state]
                whole = token >= 0
                fits.append((start, rows[whole], token[whole]))
            for start, at, token in reversed(fits):
                open_ = last[at, end] < 0
                at, token = at[open_], token[open_]
                if start and len(at):
                    ok = self.all_apart(last[at, start], token)
                    at, token = at[ok], token[ok]
                last[at, end], count[at, end] = token, count[at, start] + 1
        return count[:, 1:][inside]

    def forget(self) -> None:
        """Forget all words."""
        self.known = Numbers()
        self.counts = np.zeros(0, np.int32)
        self.starts, self.sizes, self.totals = (np.zeros(0, np.int32) for _ in range(3))
        self.blank, self.begins_blank, self.special = (np.zeros(0, bool) for _ in range(3))

    def _keep(self, ids: np.ndarray) -> np.ndarray:
        """Forget all words but those numbered in ids; returns their new numbers."""
        used = np.zeros(len(self.known), bool)
        used[ids] = True
        self.known = Numbers(zip(compress(self.known, used.tolist()), range(len(used))))
        old = np.flatnonzero(used[: len(self.sizes)])
        sizes = self.sizes[old]
        at = np.cumsum(sizes, dtype=np.int32) - sizes
        self.counts = self.counts[np.repeat(self.starts[old] - at, sizes) + np.arange(int(sizes.sum()), dtype=np.int32)]
        self.starts, self.sizes, self.totals = at, sizes, self.totals[old]
        self.blank, self.begins_blank, self.special = self.blank[old], self.begins_blank[old], self.special[old]
        return (np.cumsum(used, dtype=np.int32) - 1)[ids]

    def numbers(self, words, n: int) -> np.ndarray:
        """The number of each of n words, with new numbers for new ones; learn() then works those out."""
        return np.fromiter(map(self.known.__getitem__, words), np.int32, n)

    def learn(self) -> None:
        """Work out the counts of all prefixes, in characters, of words that have a number only. A special token has one count at each place, put right where it stands."""
        new = list(islice(reversed(self.known), len(self.known) - len(self.sizes)))[::-1]
        if not new:
            return
        special = np.array([isinstance(w, tuple) for w in new])
        words = [w[0] if isinstance(w, tuple) else w for w in new]
        data = [w.encode("utf-8", "replace") for w in words]
        lengths = np.array(list(map(len, data)))
        order = np.argsort(-lengths, kind="stable")
        by_length = list(map(data.__getitem__, order.tolist()))
        n_long = int((lengths > SHORT).sum())
        parts = [self._count_long(w) for w in by_length[:n_long]]
        for k in range(n_long, len(by_length), TOGETHER):
            parts.append(self._count_short(by_length[k : k + TOGETHER]))
        raw = np.frombuffer(b"".join(by_length) + b"\x00", np.uint8)
        # Counts at the ends of characters: before a byte that does not go on with one.
        counts = np.concatenate(parts)[(raw[1:] & 0xC0) != 0x80]
        sizes = np.array(list(map(len, words)), np.int32)
        starts = np.empty(len(words), np.int32)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        totals = counts[starts + sizes - 1]
        totals[special] = 1
        for w in LONG_CONTRACTIONS:
            if self.known.get(w, -1) >= len(self.sizes):
                counts[starts[self.known[w] - len(self.sizes)] + 1] = 2
        begins = np.array([w[0].isspace() and bool(BLANK.match(w)) for w in words])
        # A word whose second character is no white space is no run of it.
        blank = np.array([b and (len(w) == 1 or w[1].isspace()) and bool(BLANK.fullmatch(w)) for w, b in zip(words, begins.tolist())])
        self.starts = np.concatenate([self.starts, starts + len(self.counts)], dtype=np.int32)
        self.counts, self.sizes, self.totals = np.concatenate([self.counts, counts]), np.concatenate([self.sizes, sizes]), np.concatenate([self.totals, totals])
        self.begins_blank, self.blank, self.special = (np.concatenate(x) for x in ((self.begins_blank, begins), (self.blank, blank), (self.special, special)))

    def _totals(self, words: list) -> list[int]:
        ids = self.numbers(words, len(words))
        self.learn()
        return self.totals[ids].tolist()

    def _within_special(self, back: str, special: str) -> list[int]:
        """Counts of the text from the word before a special token on, at each end within the token: its string is plain text there."""
        cuts = [self.bpe.cut(back + special[:k]) for k in range(1, len(special))]
        return [sum(self._totals(c)) for c in cuts]

    def prefix_counts(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the token counts of its prefixes of 1, 2, ... characters."""
        cuts = [self.bpe.cut(t) for t in texts]
        n = np.array([len(c) for c in cuts])
        full = len(self.known) > REMEMBER
        ids = self.numbers(chain.from_iterable(cuts), int(n.sum()))
        if full:
            ids = self._keep(ids)
        self.learn()
        sizes, totals = self.sizes[ids], self.totals[ids]
        specials = np.flatnonzero(self.special[ids]).tolist() if self.bpe.special else []
        first = np.repeat(np.cumsum(n) - n, n)  # of each word, the first word of its text
        # A lot's places are fewer than 2**31, so that half as much is moved.
        at, ahead = np.cumsum(sizes, dtype=np.int32) - sizes, np.cumsum(totals, dtype=np.int32) - totals
        ahead -= ahead[first]  # tokens of the text before each word
        where = np.repeat(self.starts[ids] - at, sizes)
        where += np.arange(len(where), dtype=np.int32)
        out = self.counts[where]
        out += np.repeat(ahead, sizes)
        # White space before a word stands in two words, its last character apart; a text that ends there has it in one.
        split = np.flatnonzero(self.blank[ids[:-1]] & self.begins_blank[ids[1:]] & (first[:-1] == first[1:]))
        words = list(chain.from_iterable(cuts)) if len(split) or specials else []
        if len(split):
            text = lambda k: words[k] if isinstance(words[k], str) else words[k][0]
            out[at[split + 1]] = ahead[split] + self._totals([text(k) + text(k + 1)[0] for k in split.tolist()])
        for k in specials:
            own, start = words[k][0], int(at[k])
            back = words[k - 1] if k > first[k] and isinstance(words[k - 1], str) else ""
            base = int(ahead[k] - totals[k - 1]) if back else int(ahead[k])
            out[start : start + len(own) - 1] = np.array(self._within_special(back, own)) + base
            out[start + len(own) - 1] = ahead[k] + 1
        lengths = np.array([len(t) for t in texts])
        return np.split(out, np.cumsum(lengths)[:-1])


@lru_cache(maxsize=2)
def load(path: str) -> PrefixBpe:
    return PrefixBpe(path)


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id, n_bytes of the text in UTF-8, and counts array<int>: the token counts of its prefixes of 1, 2, ... code points.

    Each count is what the vocabulary at path makes of that prefix alone. Null and empty texts have no bytes and no counts;
    null ids stay null, repeated rows stay, other columns are left out, no rows give no rows. Texts are worked on whole, in
    lots of bounded size; a table of counts takes four bytes a code point before it is compressed.
    """

    def run(batches):
        made = load(path)
        for pdf in batches:
            at = 0
            for lot in _pieces(pdf["text"].tolist()):
                part = pdf.iloc[at : at + len(lot)]
                yield pd.DataFrame({"id": part["id"], "n_bytes": part["n_bytes"], "counts": made.prefix_counts(lot)})
                at += len(lot)

    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).cast("string").alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = d.mapInPandas(run, "id string, n_bytes long, counts array<int>")
    return out.select(F.col("id").cast("long").alias(id_col), "n_bytes", "counts")


def tokens_within(counts: Column | str, n_chars: Column | int) -> Column:
    """Tokens of a text's first n_chars code points, read from its counts: 0 for none, all of them beyond the end."""
    c = F.col(counts) if isinstance(counts, str) else counts
    n = F.least(F.lit(n_chars) if isinstance(n_chars, int) else n_chars, F.size(c)).cast("int")
    return F.when(n > 0, F.get(c, n - 1)).otherwise(F.lit(0)).cast("long")


def longest_within(counts: Column | str, budget: int) -> Column:
    """Code points of a text's longest prefix of at most budget tokens; counts may fall as a prefix grows, so the last fit is taken."""
    c = F.col(counts) if isinstance(counts, str) else counts
    fits = F.reverse(F.transform(c, lambda n: n <= budget))
    back = F.array_position(fits, F.lit(True))
    return F.when(F.lit(budget >= 0) & (back > 0), F.size(c) - back + 1).otherwise(F.lit(0)).cast("long")


def truncate(docs: DataFrame, path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id, text cut to its longest prefix of at most budget tokens, and n_tokens of that; null texts become empty."""
    def run(batches):
        made = load(path)
        for pdf in batches:
            at = 0
            for lot in _pieces(pdf["text"].tolist()):
                part = pdf["id"].iloc[at : at + len(lot)]
                fits = [(c, np.flatnonzero(c <= budget)) for c in made.prefix_counts(lot)]
                ends = [int(f[-1]) + 1 if len(f) else 0 for _, f in fits]
                yield pd.DataFrame({"id": part, "text": [t[:e] for t, e in zip(lot, ends)], "n_tokens": [int(c[e - 1]) if e else 0 for (c, _), e in zip(fits, ends)]})
                at += len(lot)

    d = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = d.mapInPandas(run, "id string, text string, n_tokens long")
    return out.select(F.col("id").cast("long").alias(id_col), F.col("text").alias(text_col), "n_tokens")


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of all documents, read from the counts of the whole texts; see prefix_counts."""
    import public_tokenizers

    counted = prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    n = tokens_within("counts", F.size("counts"))
    return counted.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > LIMIT).alias("over_limit"))
