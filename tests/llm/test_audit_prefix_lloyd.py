"""Filter audit, prefix token counts and vector codes against brute force, and on odd rows."""

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pytest

from evidentia.llm import audit, common, lloyd, prefix
from evidentia.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def failing(rows):
    """The failed letters of each (id, text, part)."""
    out = []
    for i, t, p in rows:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        bad = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        out.append((i, p or "", set(bad + "E" * copy)))
    return out


def audit_brute(rows, good, toxic):
    marked, want = failing(rows), set()
    for part in {p for _, p, _ in marked}:
        mine = [(i, bad) for i, p, bad in marked if p == part]
        steps = {}
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, x in enumerate(order):
                gone = [(i, b) for i, b in left if x in b]
                left = [(i, b) for i, b in left if x not in b]
                failed = [b for _, b in mine if x in b]
                steps[order, k + 1] = (x, len(left), len(gone), len(failed) - len(gone), sum(b == {x} for b in failed), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
        share = {x: sum(s[2] for s in steps.values() if s[0] == x) for x in "ABCDE"}
        want |= {(part, o, k, *s[1:], share[s[0]]) for (o, k), s in steps.items()}
    return want


def test_op11(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    marks = spark.read.parquet(f"{SF}/labels.parquet").collect()
    got = {tuple(r) for r in QUERIES["op11_filter_audit"](spark, SF).collect()}
    assert got == audit_brute(docs, {r["doc_id"] for r in marks if r["quality"] == 1}, {r["doc_id"] for r in marks if r["toxic"] == 1})


def test_filter_flags_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, None), (2, "", "en"), (None, "", "en"), (3, " \t\n", ""), (4, "A b# a", "de"), (4, "A b# a", "de"), (5, "A b# a", "en"), (6, "é" * 40 + "AB", None), (7, "x " * 300, "de"), (8, long, "de"), (9, long, "de"), (10, "B", "en"), *[(20 + i, "same text", "fr") for i in range(30)]]
    extra = ("key", "word", "mask", "n", "_key", "digest")
    d = spark.createDataFrame([(*r, *["z"] * len(extra)) for r in rows], ", ".join(["doc_id long, text string, lang string", *[f"{c} string" for c in extra]]))
    flags = audit.filter_flags(d)
    got = sorted((str(r["id"]), r["part"], "".join(x for k, x in enumerate("ABCDE") if r["mask"] >> k & 1)) for r in flags.collect())
    assert got == sorted((str(i), p, "".join(sorted(b))) for i, p, b in failing(rows))
    assert {(r["id"], r["copy_of"]) for r in flags.where("id in (2, 5, 9, 21)").collect()} == {(2, 1), (5, 4), (9, 8), (21, 20)}
    assert {(r["id"], r["n_words"], r["n_distinct"]) for r in flags.where("id in (1, 7, 8)").collect()} == {(1, 0, 0), (7, 300, 1), (8, 30_000, 30_000)}
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1), (4, None, 1), (20, 1, 1)], "doc_id long, quality int, toxic int")
    assert {tuple(r) for r in audit.order_report(audit.mask_counts(flags, labels)).collect()} == audit_brute(rows, {1, 20}, {4, 20})
    assert audit.order_report(audit.mask_counts(audit.filter_flags(d.limit(0)), labels)).count() == 0


BITS = ["the", "aaaa", "a", "  ", " ", "\n", "\n\n", "\t", "'re", "'ll", "'ve", "'s", "'", "!!", "--------", "==", "1234567", "é", "ü日本", "😀", "<|endoftext|>", "<|end", "|>", "<|endoftext", "Hello", "ing", "tion", "　", "\x1c", "ization", "    ", "...", " don't", "zzzz", "qx"]


def test_every_prefix():
    made, count, rng = prefix.load(vocabulary()), library(), random.Random(5)
    texts = ["".join(rng.choice(BITS) if rng.random() < 0.8 else chr(rng.randrange(32, 127)) for _ in range(rng.randint(0, 20))) for _ in range(150)] + ["<|endoftext|>" * 3, " \n <|endoftext|>\n\n x", "a" * 300, " " * 200 + "x", "!?" * 60]
    got = made.prefix_counts(texts)
    for t, g in zip(texts, got):
        assert g.tolist() == count([t[:i] for i in range(1, len(t) + 1)]), t


def test_prefixes_with_little_memory(monkeypatch):
    monkeypatch.setattr(prefix, "REMEMBER", 5)
    monkeypatch.setattr(prefix, "PAIRS", 4)
    monkeypatch.setattr(prefix, "TOGETHER", 2)
    monkeypatch.setattr(prefix, "SHORT", 6)
    made, count = prefix.PrefixBpe(vocabulary()), library()
    for t in ("several words of unlike lengths, internationalisation", "several other words; antidisestablishmentarianism 12345678"):
        assert made.prefix_counts([t, t])[1].tolist() == count([t[:i] for i in range(1, len(t) + 1)])


def test_op12(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(docs, library()(list(docs.values()))))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op12_token_counts"](spark, SF).collect()}
    assert got == {i: (len(t.encode()), want[i], want[i] > 512) for i, t in docs.items()}


def test_prefix_questions(spark):
    long = "lorem ipsum 😀 dolor " * 20_000 + "x" * 200_000
    rows = [(1, "they'll see  us"), (1, "they'll see  us"), (2, None), (3, ""), (None, "<|endoftext|> end"), (4, long)]
    d = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, counts string")
    count, made = library(), prefix.prefix_counts(d, vocabulary()).cache()
    assert sorted((str(r["doc_id"]), r["n_bytes"], len(r["counts"])) for r in made.collect()) == sorted((str(i), len((t or "").encode()), len(t or "")) for i, t in rows)
    for n in (-1, 0, 6, 13, 10_000_000):
        got = {r["doc_id"]: r["t"] for r in made.select("doc_id", prefix.tokens_within("counts", n).alias("t")).collect()}
        assert got == dict(zip([i for i, _ in rows], count([(t or "")[: max(n, 0)] for _, t in rows])))
    for budget in (-1, 0, 1, 2, 3, 1_000):
        ends = {r["doc_id"]: r["n"] for r in made.select("doc_id", prefix.longest_within("counts", budget).alias("n")).collect()}
        for i, t in rows[1:5]:
            assert ends[i] == max([k for k in range(len(t or "") + 1) if count([(t or "")[:k]])[0] <= budget], default=0)
        cuts = prefix.truncate(d, vocabulary(), budget).collect()
        assert sorted((str(r["doc_id"]), len(r["text"])) for r in cuts) == sorted((str(i), ends[i]) for i, _ in rows)
        assert [r["n_tokens"] for r in cuts] == count([r["text"] for r in cuts])
    assert prefix.prefix_counts(d.limit(0), vocabulary()).count() == 0 and prefix.truncate(d.limit(0), vocabulary(), 3).count() == 0


def test_vocabulary_of_two_ways_is_refused(tmp_path):
    import json

    spec = json.load(open(vocabulary()))
    spec["model"]["vocab"]["abc"] = 60_000
    spec["model"]["vocab"]["ab"], spec["model"]["vocab"]["bc"] = 60_001, 60_002
    spec["model"]["merges"] += [["a", "b"], ["b", "c"], ["ab", "c"], ["a", "bc"]]
    json.dump(spec, open(tmp_path / "w.json", "w"))
    with pytest.raises(ValueError):
        prefix.PrefixBpe(str(tmp_path / "w.json"))


def lloyd_brute(rows, parts=4, entries=256, rounds=4):
    """rows (id, vector, label) with finite vectors."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [math.floor(1024 * x) for x in r[1]]))
    v = [[math.floor(1024 * x) for x in r[1]] for r in rows]
    w = len(v[0]) // parts
    cutp = lambda x, p: x[p * w : (p + 1) * w]
    books = [[cutp(x, p) for x in v[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda: [[min(range(len(books[p])), key=lambda e: (far(cutp(x, p), books[p][e]), e)) for p in range(parts)] for x in v]
    for _ in range(rounds):
        at = near()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cutp(x, p) for x, a in zip(v, at) if a[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    at = near()
    error = [sum(far(cutp(x, p), books[p][a[p]]) for p in range(parts)) for x, a in zip(v, at)]
    by = {}
    for r, e in zip(rows, error):
        by[r[2]] = by.get(r[2], 0) + e
    return sorted((str(r[0]), "".join(f"{x:02x}" for x in a), e, by[r[2]]) for r, a, e in zip(rows, at, error)), books


@pytest.mark.parametrize("spread,entries,size", [(1.0, 16, 300), (0.002, 7, 400), (9_000.0, 12, 200), (100_000.0, 5, 60)])
def test_codes(spark, spread, entries, size):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8)) * spread
    rows = [(int(i), (centres[i % 6] + rng.normal(size=8) * spread / 20).clip(-100_000, 100_000).tolist(), int(i) % 3) for i in range(size)]
    rows += [(1000 + i, rows[i][1], None) for i in range(40)] + [rows[5], rows[5]]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    coded, books = lloyd.compress(d, entries=entries)
    want, want_books = lloyd_brute(rows, entries=entries)
    assert books.tolist() == want_books
    assert sorted((str(r["id"]), r["code"], r["error"], r["label_error"]) for r in coded.collect()) == want


def test_trees_give_subtrees_whole():
    rng = np.random.default_rng(1)
    entries = np.array([[0, 0], [5_000, 5_000], [0, 5_000]])
    points = np.concatenate([e + rng.integers(-50, 50, (400, 2)) for e in entries]).astype(np.int32)
    order, low, high, sums = lloyd.build(points)
    nearest, total, count = lloyd.assign(points[order], low, high, sums, entries)
    assert count.tolist() == [400, 400, 400] and total.tolist() == [points[k * 400 : (k + 1) * 400].sum(0).tolist() for k in range(3)]
    assert (nearest == order // 400).all()
    # Far boxes: every entry but one is beaten for each of the top four subtrees' boxes.
    assert lloyd.beaten(np.array([[-50.0, -50.0]]), np.array([[49.0, 49.0]]), np.array([0]), entries.astype(float)).tolist() == [[False, True, True]]
    # As near at the best corner: the lower index stays.
    tie = np.array([[0.0, 0.0], [4.0, 0.0]])
    assert lloyd.beaten(np.array([[2.0, 0.0]]), np.array([[2.0, 1.0]]), np.array([0]), tie).tolist() == [[False, True]] and not lloyd.beaten(np.array([[2.0, 0.0]]), np.array([[2.0, 1.0]]), np.array([1]), tie).any()


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 2)
    monkeypatch.setattr(common, "HOT_KEYS", 3)
    nan, inf = float("nan"), float("inf")
    rows = [(3, [0.0, 0.0, 0.0, 0.0], 1), (None, [0.5, -0.5, 0.1, 0.2], None), (4, [0.5, -0.5, 0.1, 0.2], None), (4, [0.5, -0.5, 0.1, 0.2], None), (5, None, 1), (6, [], 1), (7, [1.0, None, 1.0, 1.0], 1), (8, [nan, 0.0, 0.0, 0.0], 1), (9, [inf, 0.0, 0.0, 0.0], 2), (10, [-0.0001, 0.0, 0.0, 0.00001], 1), (11, [1.0, 2.0], 7)]
    d = spark.createDataFrame([(*r, "z", "z") for r in rows], "vec_id long, embedding array<float>, label int, code string, id string")
    coded, _ = lloyd.compress(d)
    got = coded.collect()
    fine = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows if i in (3, None, 4, 10)]
    want, _ = lloyd_brute(fine)
    assert sorted((str(r["id"]), r["code"], r["error"], r["label_error"]) for r in got if r["code"] is not None) == want
    assert sorted((r["id"], r["code"], r["error"]) for r in got if r["code"] is None) == [(6, None, None), (11, None, None)] and len(got) == len(want) + 2
    empty, books = lloyd.compress(d.limit(0))
    assert empty.count() == 0 and not books.size
    assert [(r["code"], r["error"]) for r in lloyd.compress(d.where("vec_id = 6"))[0].collect()] == [("00000000", 0)]
    with pytest.raises(ValueError):
        lloyd.compress(d.where("vec_id = 11"))
    with pytest.raises(ValueError):
        lloyd.compress(spark.createDataFrame([(1, [1e9] * 4, 1)], "vec_id long, embedding array<double>, label int"))


def test_op13(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = QUERIES["op13_vector_codes"](spark, SF).collect()
    v = np.floor(1024 * np.array([r[1] for r in sorted(rows)])).astype(np.int64)
    books = [p[:256].copy() for p in np.split(v, 4, axis=1)]
    for k in range(5):
        near = [((p[:, None] - b[None]) ** 2).sum(2).argmin(1) for p, b in zip(np.split(v, 4, axis=1), books)]
        for p, b, a in zip(np.split(v, 4, axis=1), books, near) if k < 4 else ():
            for e in set(a.tolist()):
                b[e] = p[a == e].sum(0) // (a == e).sum()
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()}
    assert {r["vec_id"]: r["code"] for r in got} == {r[0]: "".join(f"{a[k]:02x}" for a in near) for k, r in enumerate(sorted(rows))}
    assert len(got) == len(rows) and sum(r["error"] for r in got) == sum({(r["label_error"]) for r in got})
