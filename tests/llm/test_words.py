"""Words cut by both patterns, and what is remembered of them."""

import random

import public_tokenizers
import pytest

from evidentia.llm import bpe, prefix

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(3))
def test_both_patterns_cut_alike(seed):
    rng, made = random.Random(seed), bpe.load(PATH)
    chars = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x10000))]
    for _ in range(300):
        text = "".join(rng.choice([rng.choice(chars), *" \n\t\x1c\x85　a1'é²中", "'re"]) for _ in range(60))
        assert made.plain_words.findall(text) == made.words.findall(text) and made.cut("𝒳" + text) == made.words.findall("𝒳" + text)


def test_words_in_use_are_not_forgotten(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    monkeypatch.setattr(prefix, "REMEMBER", 3)
    made, memory, asked = bpe.ByteBpe(PATH), {}, []
    encode = made.encode_words
    monkeypatch.setattr(made, "encode_words", lambda words: asked.append(sorted(words)) or encode(words))
    for text in ("one two three four", "two three five", "two"):
        bpe.encode_texts(made, [text], memory, len)
    assert asked == [[" four", " three", " two", "one"], [" five", "two"], []]
    counts = prefix.PrefixBpe(PATH)
    for text in ("one two’s naïve 'll\n  straße", "two’s naïve\n  straße 'll", "so 'll"):
        got = counts.prefix_counts([text])[0].tolist()
        assert got == [len([i for w in made.cut(text[:k]) for i in encode([w])[0]]) for k in range(1, len(text) + 1)]
    assert set(counts.known) >= {"so"} and "one" not in counts.known


def test_words_are_looked_up_once_a_lot(monkeypatch):
    asked = []

    class Word(str):
        def __hash__(self):
            asked.append(str(self))
            return super().__hash__()

    counts = prefix.PrefixBpe(PATH)
    text = "one two two<|endoftext|> two \n two"
    want = [c.tolist() for c in counts.prefix_counts([text, "", text])]
    cut = counts.bpe.cut
    monkeypatch.setattr(counts.bpe, "cut", lambda t: [w if isinstance(w, tuple) else Word(w) for w in cut(t)])
    got = counts.prefix_counts([text, "", text])
    assert [c.tolist() for c in got] == want and got[1].tolist() == []
    asked.clear()
    assert len(counts.prefix_counts(["one two two two"])[0]) == 15 and sorted(asked) == sorted(["one", " two", " two", " two"])
