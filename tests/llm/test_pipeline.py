"""The pipeline's stages on rows with null and repeated ids."""

from collections import Counter

import pytest

import corpus_pipeline as cp
from evidentia.llm import packing
from evidentia.llm.queries import QUERIES
from tests.llm.test_brute import lines_brute, near_brute, pii_brute, texts

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
TEXT = "one two three four five six seven eight"


def rows_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def parquet(spark, tmp_path, rows):
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC).repartition(3).write.parquet(f"{tmp_path}/docs")
    return spark.read.parquet(f"{tmp_path}/docs")


def test_near_duplicates_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "null id with words of its own here"), (None, ""), (None, ""), (1, TEXT), (1, TEXT), (2, TEXT), (3, ""), (3, ""), (4, None), (4, None), (5, "alpha beta gamma delta epsilon"), (5, "other text under the same id")]
    got = rows_of(cp.drop_near_duplicates(spark, parquet(spark, tmp_path, rows), SF))
    want = Counter(set(rows) - {(2, TEXT), (None, "")}) + Counter({(None, ""): 2})
    assert got == want


def test_sanitise_null_and_repeated_ids(spark, tmp_path):
    rows = [(1, "a@b.cd"), (1, "a@b.cd"), (1, "see x@y.zz there"), (2, "plain"), (None, "me@x.org"), (None, "nothing")]
    got = rows_of(cp.sanitise(spark, parquet(spark, tmp_path, rows), SF))
    assert got == Counter({(1, "<EMAIL>"): 2, (1, "see <EMAIL> there"): 1, (2, "plain"): 1, (None, "<EMAIL>"): 1, (None, "nothing"): 1})


def test_lines_null_and_repeated_ids(spark, tmp_path):
    rows = [(1, TEXT), (1, TEXT), (None, TEXT), (None, None), (2, "short")]
    got = rows_of(cp.drop_lines(spark, parquet(spark, tmp_path, rows), SF))
    assert got == Counter({(1, TEXT): 1, (1, ""): 1, (None, ""): 1, (None, None): 1, (2, "short"): 1})


def test_run_against_brute_force(spark):
    docs = texts(spark)
    good = {r["doc_id"] for r in QUERIES["op10_quality_classifier"](spark, SF).where("predicted = 1").collect()}
    docs = lines_brute({i: t for i, t in docs.items() if i in good})
    kept = {i for i, _, _, k in near_brute(docs, 80) if k}
    docs = {i: t for i, t in docs.items() if i in kept}
    tags = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "secret": "<SECRET>", "term": "<TERM>"}
    want = {}
    for i, spans in pii_brute(docs)[0].items():
        out, at = "", 0
        for k, a, b in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
            if a >= at:
                out += docs[i][at:a] + tags[k]
            at = max(at, b)
        want[i] = len([w for w in (out + docs[i][at:]).replace("\n", " ").split(" ") if w])
    rows = cp.run(spark, SF).collect()
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert {i: got[i] for i in {r["doc_id"] for r in rows}} == want
    fill = Counter()
    for r in rows:
        fill[r["bin_id"]] += r["length"]
    assert all(r["bin_capacity"] == min(c for c in packing.CAPACITIES if c >= fill[r["bin_id"]]) for r in rows)


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_on_odd_rows(spark, name):
    stage = dict(cp.STAGES)[name]
    extra = ("_key", "key", "line", "spans", "digest", "score", "kept", "bin")
    rows = [(None, "null id, some words of its own"), (None, None), (1, "same words\nsame words"), (1, "same words\nsame words"), (2, ""), (3, "mail a@b.cd " + "word " * 50_000)]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * len(extra)) for i, t in rows], ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *[f"{c} string" for c in extra]]))
    out = stage(spark, d, "/root/testdata/sf0.001")
    ids = [str(r["doc_id"]) for r in out.select("doc_id").collect()]
    if name == "best_fit_packing":
        assert set(ids) == {"None", "1", "2", "3"}
    else:
        assert out.columns == list(cp.COLUMNS) and set(ids) <= {"None", "1", "2", "3"}
        assert ids.count("1") == {"minhash_near_dedup": 1}.get(name, ids.count("1")) and ids.count("1") <= 2
    assert stage(spark, d.limit(0), "/root/testdata/sf0.001").count() == 0
