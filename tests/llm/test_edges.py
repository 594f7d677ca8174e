"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import hashlib
import random
import time
from collections import Counter

import pytest

import corpus_pipeline
from verdictspark.llm import queries
from verdictspark.llm.secret_scan import scan, secret_spans
from verdictspark.llm.sharding import shard

LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
COPY = " ".join(f"copy{i}" for i in range(50))
DOCS = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, COPY), (6, COPY), (6, COPY), (None, "a row without an id"), (7, LONG), (8, COPY + " tail"), (9, "é ß 漢字 \x0b end"), (10, "api_key = 'abcdefgh12345678'")]
EXTRA = ("id", "key", "tid", "class", "component", "root", "rank", "size", "label", "score", "item_id", "slot", "shard", "found", "bucket", "copies")
TALKS = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", None), (None, None, None, None), (None, 3, "tool", "[/TURN]"), (2, 5, "assistant", LONG), (3, 1, "assistant", "b"), (3, 1, "assistant", "a")]
TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in EXTRA),
    "labels": "doc_id long, quality int, toxic int, text string, score string, source string",
    "pages": "page_id long, url string, html string, text string, n_chars string, main_text string",
    "benchmark": "item_id string, text string, doc_id string",
    "conversations": "conv_id long, turn long, role string, text string, id string, parent string, root string, rank string, depth string",
}
ROWS = {
    "documents": [(i, t, None, "s", None if t is None else len(t), *EXTRA) for i, t in DOCS],
    "labels": [(1, 1, None, "x", "y", "z"), (2, None, 1, "x", "y", "z"), (None, 1, 1, "x", "y", "z"), (99, 0, 0, None, None, None), (5, 1, 0, "", "", ""), (5, 0, 1, "", "", ""), (7, 0, 0, "", "", "")],
    "pages": [(1, None, None, "t", "n", "m"), (2, "u", "", "t", "n", "m"), (None, "u", "<p>" + LONG, "t", "n", "m"), (3, "u", "no markup at all <", "t", "n", "m"), (3, "u", "<a <b>&amp;&#x;<", "t", "n", "m")],
    "benchmark": [(None, None, "d"), ("i1", None, "d"), ("i2", "", "d"), ("i3", " ".join(COPY.split()[:20]), "d"), ("i3", " ".join(COPY.split()[20:45]), "d")],
    "conversations": [(*r, "x", "y", "z", "u", "v") for r in TALKS],
}


def _write(spark, where, rows):
    for name, schema in TABLES.items():
        spark.createDataFrame(rows[name], schema).write.parquet(f"{where}/{name}.parquet")
    return str(where)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("odd"), ROWS)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("nothing"), {name: [] for name in TABLES})


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, nothing, name):
    rows = queries.QUERIES[name](spark, nothing).collect()
    assert [r["conv_id"] for r in rows] == [-1] if name.startswith("op12_") else rows == []


def test_pipeline_on_empty_tables(spark, nothing):
    assert corpus_pipeline.run(spark, nothing).collect() == []


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if not n.startswith(("op2_", "op4_", "op7_", "op12_"))])
def test_a_row_for_each_document(spark, odd, name):
    rows = queries.QUERIES[name](spark, odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in DOCS)


def test_secrets(spark, odd):
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_secret_scan"](spark, odd).collect()}
    assert got[10]["n_assign"] == 1 and got[10]["spans"] == "assign:0:27"
    assert all(got[i]["spans"] == "" and got[i]["base_sha256"] == hashlib.sha256(b"").hexdigest() for i in (1, 2, 3, 4))


def test_packing(spark, odd):
    rows = queries.QUERIES["op2_best_fit_packing"](spark, odd).collect()
    pieces, firsts = Counter(r["doc_id"] for r in rows), Counter(r["doc_id"] for r in rows if r["piece"] == 0)
    assert firsts == Counter(i for i, _ in DOCS) and pieces[6] == 2 and pieces[7] > 50 and {r["length"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}


def test_join(spark, odd):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op3_ngram_jaccard_join"](spark, odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 48, 5), (6, 48, 5), (8, 49, 5)} <= got


def test_a_long_text_of_keys_takes_time_in_proportion():
    rng = random.Random(5)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    text = "\n".join(f"token = {key()}" for _ in range(4_000))
    began = time.perf_counter()
    assert len(scan(text)) == 8_000
    once = time.perf_counter() - began
    began = time.perf_counter()
    assert len(scan("\n".join([text] * 8))) == 64_000
    assert time.perf_counter() - began < 24 * once


def test_five_megabytes_of_keys(spark):
    rng = random.Random(6)
    text = "\n".join("secret: " + "".join(rng.choices("0123456789abcdef", k=64)) for _ in range(72_000))
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    found = {r["doc_id"]: len(r["found"]) for r in secret_spans(docs).collect()}
    assert len(text) > 5_000_000 and found == {1: 144_000, 2: 0}


def test_ten_thousand_equal_texts_share_a_shard(spark):
    docs = spark.range(13_000).selectExpr("id AS doc_id", "CASE WHEN id < 5000 THEN NULL WHEN id < 10000 THEN '' ELSE concat('text ', id) END AS text")
    rows = shard(docs, 4).collect()
    assert len(rows) == 13_000 and len({r["shard"] for r in rows if r["doc_id"] < 10_000}) == 1
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    bytes_ = Counter()
    for r in rows:
        bytes_[r["shard"]] += r["size"]
    assert max(bytes_.values()) - min(bytes_.values()) <= 60


def test_pages(spark, odd):
    got = queries.QUERIES["op4_html_extraction"](spark, odd).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] in (1, 2)] == ["", ""]


def test_scores(spark, odd):
    for name in ("op5_toxicity", "op6_quality_classifier"):
        rows = queries.QUERIES[name](spark, odd).collect()
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_leaks(spark, odd):
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op7_decontamination"](spark, odd).collect()}
    assert got == {(5, "i3"), (6, "i3"), (8, "i3")}


def test_repeats(spark, odd):
    got = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in queries.QUERIES["op10_substring_dedup"](spark, odd).collect()}
    assert {(1, 0, 0), (2, 0, 0), (3, 0, 0), (5, 50, 50), (6, 50, 50), (7, 60_000, 0), (8, 51, 50)} <= got


def test_pipeline_stages(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
    deduped = corpus_pipeline.drop_near_duplicates(spark, docs, odd)
    assert Counter(r["doc_id"] for r in deduped.collect()) == Counter([1, 2, 3, 4, 5, None, 7, 9, 10])
    clean = corpus_pipeline.drop_benchmark_leaks(spark, docs, odd)
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter([1, 2, 3, 4, None, 7, 9, 10])
    hidden = {r["doc_id"]: r for r in corpus_pipeline.redact_secrets(spark, docs, odd).collect()}
    assert hidden[10]["text"] == "[SECRET]'" and hidden[10]["n_chars"] == 9 and hidden[1]["text"] is None
