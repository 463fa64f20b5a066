"""Nulls, empty and long texts, repeated rows, empty tables and clashing names, for every operator."""

import time

import pytest
from pyspark.sql import functions as F

from evidentia.llm import bpe, chat, embeddings, fingerprints, lines, minhash, packing, pii, quality, urls
from evidentia.llm.queries import QUERIES

EXTRA = ("_id", "_key", "_gone", "_spans", "_row", "_j", "_stats", "id", "key", "line", "text2", "pos", "n", "digest", "own", "row")
ROWS = [(None, "null id, words of its own are here"), (None, None), (1, "same line of words here\nsame line of words here"), (1, "same line of words here\nsame line of words here"), (1, "other text a@b.cd"), (2, ""), (3, " \t\n"), (4, None), (5, "x"), (6, "mail a@b.cd and 1.2.3.4")]


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def labels(spark):
    return spark.createDataFrame([(None, 1, 0), (1, 1, 0), (1, 0, 0), (5, None, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "packing": lambda s, d: packing.best_fit_pack(d, packing.n_words(F.col("text"))), "fingerprints": lambda s, d: fingerprints.compare_neighbours(d), "minhash": lambda s, d: minhash.near_duplicates(d),
    "lines": lambda s, d: lines.dedup_lines(d), "bpe": lambda s, d: bpe.tokenize(d, vocabulary()), "find_pii": lambda s, d: pii.find_pii(d), "redact": lambda s, d: pii.redact(d),
    "quality": lambda s, d: quality.score_quality(d, labels(s)),
}


def documents(spark, rows):
    return spark.createDataFrame([(i, t, *["x"] * len(EXTRA)) for i, t in rows], ", ".join(["doc_id long", "text string", *[f"{c} string" for c in EXTRA]]))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_documents(spark, name):
    out = OPERATORS[name](spark, documents(spark, ROWS))
    got = out.collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in ROWS)
    if name in ("lines", "redact", "quality"):
        assert set(EXTRA) <= set(out.columns) and all(r[c] == "x" for r in got for c in EXTRA)
    assert OPERATORS[name](spark, documents(spark, ROWS).limit(0)).count() == 0


def test_odd_documents_results(spark):
    d = documents(spark, ROWS)
    kept = [(r["doc_id"], r["n_removed"], r["text"]) for r in lines.dedup_lines(d).collect()]
    same = "same line of words here"
    assert sorted(t for i, n, t in kept if i == 1) == ["", "other text a@b.cd", same] and (None, 0, None) in kept and (3, 0, " \t\n") in kept
    red = [(r["doc_id"], r["text"]) for r in pii.redact(d).collect()]
    assert (1, "other text <EMAIL>") in red and (6, "mail <EMAIL> and <IP>") in red and red.count((1, f"{same}\n{same}")) == 2
    near = minhash.near_duplicates(d).collect()
    assert sum(r["kept"] for r in near if r["doc_id"] == 1) == 2 and all(r["kept"] and not r["n_shingles"] for r in near if r["doc_id"] in (2, 3, 4))
    assert {r["score"] for r in quality.score_quality(d.where("doc_id <> 1 or doc_id is null"), labels(spark).limit(0)).collect()} == {1.0}


def test_long_texts(spark):
    words = " ".join(f"w{i * 7919 % 60_013}" for i in range(200_000))
    rows = [(1, f"{words} mail a@b.cd {words[:400_000]} 10.0.0.1"), (2, "a\n" * 50_000), (3, "1.2.3.4 x@y.zz " * 3_000)] + [(10 + i, f"number{i} a@b.cd signed zorb") for i in range(30)] + [(90 + i, f"plain {i} text") for i in range(90)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    start = time.time()
    spans = {r["doc_id"]: r["spans"] for r in pii.find_pii(d).collect()}
    assert time.time() - start < 90
    kinds = lambda i: [s["kind"] for s in spans[i]]
    assert [k for k in kinds(1) if k != "term"] == ["email", "ip"] and kinds(3).count("ip") == kinds(3).count("email") == 3_000
    at = rows[0][1].index("a@b.cd")
    assert (spans[1][0]["start"], spans[1][0]["end"]) == (at, at + 6) and "term" in kinds(10)
    assert {r["doc_id"]: r["n_shingles"] for r in minhash.near_duplicates(d).collect()}[1] > 60_000
    out = {r["doc_id"]: r for r in lines.dedup_lines(d).collect()}
    assert out[2]["n_lines"] == 50_001 and out[2]["n_removed"] == 49_999
    assert quality.statistics(rows[0][1])[0] > 12 and len(fingerprints.fingerprint(rows[0][1].encode())) == 130


def test_secrets(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(i, t) for i, t in enumerate([f'token = "{key}"', "a" * 40, "https://a.b/some-long-slug-of-words-2024", "1" * 30, f"x@{key}.org", "supercalifragilisticexpialidocious1234"])]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == [("secret", 9, 49)] and not got[1] and not got[2] and not got[3] and [k for k, _, _ in got[4]] == ["email"]


def test_kinds_reveal_terms(spark):
    # No address stands twice, but nearly all texts with the word "kontakt" hold one; a word of all texts reveals nothing.
    rows = [(i, f"kontakt word{i} p{i}@mail.example.com of some words") for i in range(40)] + [(100 + i, f"of some words here word{i} {i}") for i in range(400)] + [(900, "kontakt is here of some words")]
    got = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == "<TERM> word0 <EMAIL> of some words" and got[900] == "<TERM> is here of some words" and got[101] == rows[41][1]


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, "x", "y"), (1, None, "x", "y"), (None, "http://a.net/es/" + "q" * 100_000, "x", "y"), (3, "", "x", "y"), (4, "http://a.org/", "x", "y")], "page_id long, url string, _j string, rule string")
    out = urls.filter_urls(spark, pages)
    got = {(r["page_id"], r["rule"], r["verdict"], r["_j"]) for r in out.collect()}
    assert out.count() == 5 and got == {(1, None, "allow", "x"), (None, "net/es/", "block", "x"), (3, None, "allow", "x"), (4, None, "allow", "x")}
    assert urls.filter_urls(spark, pages.limit(0)).count() == 0
    twice = urls.filter_urls(spark, pages, [("a.org/", "block"), ("a.org/", "allow"), ("org/", "block")])
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in twice.collect()}[4] == ("a.org/", "allow")
    assert urls.filter_urls(spark, pages, []).where("verdict = 'allow'").count() == 5


def test_urls_in_several_arrays(spark, monkeypatch):
    monkeypatch.setattr(urls, "ARRAY_RULES", 2)
    rules = [("org/", "block"), ("a.org/", "allow"), ("b.org/x/", "allow"), ("net/", "block"), ("c.net/", "allow")]
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.org/x/"), (3, "http://c.net/"), (4, "http://d.net/")], "page_id long, url string")
    assert {r["page_id"]: r["rule"] for r in urls.filter_urls(spark, pages, rules).collect()} == {1: "a.org/", 2: "b.org/x/", 3: "c.net/", 4: "net/"}


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", None), (None, 0, None, "x"), (2, None, "assistant", "é" * 30_000), (2, 5, "assistant", "<|im_start|>user\nhi"), (2, 5, "assistant", "<|im_start|>user\nhi")]
    c = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    for chunk in (1, 50, chat.CHUNK):
        back, learnt = {}, {}
        for r in chat.assemble_conversations(chat.format_turns(c), chunk).orderBy("conv_id", "chunk").collect():
            back.setdefault(r["conv_id"], []).extend(chat.read_turns(r["formatted"]))
            learnt.setdefault(r["conv_id"], []).extend(chat.unescape(r["formatted"][s - r["start"] : s - r["start"] + n]) for s, n in zip(r["loss_starts"], r["loss_lengths"]))
        assert back == {None: [("", "x")], 1: [("user", ""), ("assistant", "b<|im_end|>")], 2: [("assistant", t) for t in ("é" * 30_000, "<|im_start|>user\nhi", "<|im_start|>user\nhi")]}
        assert learnt == {None: [], 1: ["b<|im_end|>"], 2: [t for _, t in back[2]]}
    got = {r["conv_id"]: r for r in chat.digest_conversations(chat.assemble_conversations(chat.format_turns(c), 50)).collect()}
    assert got[2]["n_turns"] == 3 and got[1]["formatted_chars"] == sum(len(chat.START) + len(r) + 1 + len(chat.escape(t)) + len(chat.END) for r, t in (("user", ""), ("assistant", "b<|im_end|>")))
    assert chat.assemble_conversations(chat.format_turns(c.limit(0))).count() == 0


def test_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (1, v, 1), (None, v, 1), (2, [3.0, -1.0, 0.5], 1), (3, [1.0, None, 2.0], 1), (4, [], 1), (5, [1.0, 2.0], 1), (6, v, None)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, digest string")
    got = embeddings.near_vectors(d).collect()
    assert sorted((str(r["vec_id"]), r["n_links"]) for r in got) == sorted([("1", 2), ("1", 2), ("None", 2), ("2", 0), ("3", 0), ("4", 0), ("5", 0), ("6", 0)]) and sum(r["kept"] for r in got) == 6


@pytest.mark.parametrize("name", ["op2_url_filter", "op3_document_fingerprints", "op8_embedding_dedup", "op9_pii", "op10_quality_classifier", "op6_line_dedup"])
def test_queries_give_a_row_for_each(spark, name):
    d = "/root/testdata/sf0.001"
    source = {"op2": "pages", "op8": "embeddings"}.get(name.split("_")[0], "documents")
    assert QUERIES[name](spark, d).count() == spark.read.parquet(f"{d}/{source}.parquet").count()


def test_secrets_are_read_whole(spark):
    # Only the end of the run tells that it is no word.
    run = "ab1" * 100 + "cdefghij23"
    got = pii.find_pii(spark.createDataFrame([(1, run)], "doc_id long, text string")).first()["spans"]
    assert [(s["kind"], s["start"], s["end"]) for s in got] == [("secret", 0, len(run))]


def test_many_small_pieces_are_tried_one_by_one():
    # What is left fills a bin of 512 with 2 + 170 * 3, and one of 64 with 2 + 20 * 3 only.
    pieces = [3] * 400 + [2]
    bins = packing.pack_lengths(pieces, (64, 512), overhead=0, attention=10**9)
    held = {}
    for n, (k, _) in zip(pieces, bins):
        held.setdefault(k, []).append(n)
    assert all(sum(v) <= 512 for v in held.values()) and sum(map(len, held.values())) == 401
    assert packing.pack_lengths([0] * 5_000 + [1] * 5, (4, 8))[-1][0] == 0


def test_no_plan_of_line_dedup_holds_the_table_of_rarity(spark):
    lines_ = lines._lines(spark.createDataFrame([(1, "a b c\nd e f g"), (2, "a b c\nd e")], "id long, text string"))
    index = lines._index(lines_, lines._rarity(lines_), 80)
    both = index.alias("x").join(index.alias("y"), F.expr(f"x.c = y.c and x.key <> y.key and {lines._near(80)}"), "left_semi")
    both.collect()
    told = both._jdf.queryExecution().toString()
    assert len(told) < 100_000 and "ReusedExchange" in told and "array_distinct(" not in "".join(x for x in told.split("\n") if "Filter" in x)


def test_common_words_are_no_candidates_over_the_texts(spark, monkeypatch):
    monkeypatch.setattr(pii, "PARTS", (2, 16), raising=False)
    tried, slots = [], pii._slots
    monkeypatch.setattr(pii, "_slots", lambda terms: tried.append({r["term"] for r in terms.distinct().collect()}) or slots(terms))
    rows = [(k, f"common w{k}" + " secretive a@b.cd" * (k < 40)) for k in range(800)]
    spans = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans[1] == ["email", "term"] and spans[700] == [] and "secretive" in tried[0] and not any("common" in t for t in tried)
