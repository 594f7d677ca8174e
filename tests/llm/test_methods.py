"""The methods' own parts: extraction, templates, search, models and the JPEG reader."""

import itertools
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from verdictspark.llm import decontamination, html_blocks, media, packing, repeats, secret_scan, words
from verdictspark.llm.graph import components
from verdictspark.llm.jaccard import near_duplicates, one_of_each, with_component_ids
from verdictspark.llm.queries import QUERIES
from verdictspark.llm.repeats import without_repeats
from verdictspark.llm.tables import join_hot, keep
from verdictspark.llm.tokens import tokenizer
from verdictspark.llm.toxicity import FINDINGS, findings, forest, label_model

SF = "/root/testdata/sf{}"


def test_marginal_bytes_tell_keys_from_identifiers():
    text = "session cookie = "
    key, name = "q8Zr2LxT0vYb7NcWkJ4d", "configuration_settings_2"
    costs = [secret_scan.marginal_bytes(text + x, len(text), len(text) + len(x), 96) / len(x) for x in (key, name)]
    assert costs[0] > 0.62 > costs[1]
    assert [s[0] for s in secret_scan.scan(text + key)] == ["novel"]
    assert secret_scan.scan(text + name) == [] and secret_scan.scan("the number " + key) == []


def test_every_line_of_a_key_block_is_found():
    rng = np.random.default_rng(5)
    line = lambda n: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), n))
    body = [*(line(64) for _ in range(12)), line(9) + "="]
    for kind, sep in itertools.product(("PRIVATE KEY", "RSA PRIVATE KEY", "CERTIFICATE"), ("\n", "\r\n", "\\n")):
        pem = sep.join([f"-----BEGIN {kind}-----", *body, f"-----END {kind}-----"])
        text = f"Some words before.{sep}{pem}{sep}and words after it"
        spans = secret_scan.scan(text)
        left = secret_scan.redact(text, spans)
        assert not [x for x in body if x in left], (kind, sep)
        assert left.startswith("Some words before.") and left.endswith("and words after it")
    prose = "\n".join(["The private key is with them", "and_the_words_of_the_next_line_1", "stay as they are here"])
    assert secret_scan.scan(prose) == []


def test_a_key_given_twice_is_found_twice():
    key = "q8Zr2LxT0vYb7NcWkJ4d"
    for text in (f"AUTH={key}\nBearer {key} is sent", f"token {key} then token {key}", "\n".join([f"cookie {key}"] * 9), f"auth {key} {'x ' * 43}{key} auth"):
        assert sum(b - a >= len(key) for _, a, b, _ in secret_scan.scan(text)) == text.count(key)
        assert key not in secret_scan.redact(text, secret_scan.scan(text))


def test_planted_secrets_are_redacted_and_look_alikes_stay():
    rng = np.random.default_rng(17)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    made = lambda n, more="": "".join(rng.choice(letters + list(more), n))
    kinds = {
        "the token {} was sent": lambda: ".".join(["eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9", "eyJzdWIi" + made(60, "-_"), made(43, "-_")]),
        "see postgres://admin:{}@db.host:5432/main for it": lambda: made(12),
        "Authorization: Bearer {} then": lambda: made(32),
        "the session cookie is {} today": lambda: made(24, "-_"),
    }
    for shape, value in kinds.items():
        gone = 0
        for _ in range(200):
            v = value()
            text = f"Some words stand here. {shape.format(v)} and more words follow."
            left = secret_scan.redact(text, secret_scan.scan(text))
            gone += not any(part in left for part in v.split("."))
        assert gone >= 190, (shape, gone)
    names = "user order config session token request handler count value limit index buffer parser stream record".split()
    clean = [
        "certificate of deposit ABC-2024-000123-XY", "author https://example.com/blog/2024/03/15/some-title-of-a-post-7", "secret = ${MY_SECRET_NAME_FROM_ENV_2}",
        "salt lake city route I-15/US-89/UT-201/exit-305", "the passage in chapter-12/section-3b/page-204 is long", "postgres://admin:${DB_PASSWORD_1}@host", "postgres://admin:password@host",
        *(f"auth token for {'_'.join(rng.choice(names, 4))}_{k} is read" for k in range(100)), *(f"the session of {''.join(x.title() for x in rng.choice(names, 3))}Service{k} ends" for k in range(100)),
    ]
    false = [c for c in clean if secret_scan.scan(c)]
    assert len(false) <= 2, false


def test_extraction_of_a_page():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav>
    <div class="cookie-notice">We use cookies</div><article><header><h1>A title &amp; more</h1></header>
    <p>First  paragraph of
    the text.</p><p>Second.</p><div class="advert">Buy now</div><script>var x = "<p>no</p>";</script>
    <ul><li>one item</li></ul></article><section id="comments"><p>A reader says that this is of the best.</p></section>
    <footer>All rights</footer></body></html>"""
    assert html_blocks.main_text(page) == "A title & more\nFirst paragraph of the text.\nSecond.\none item"


def test_undecided_blocks_take_their_neighbours_label():
    long = "This is the text of a block that is long enough to be good for the first pass of the rules."
    page = f"<div><p>{long}</p><p>Short one</p><p>{long}</p></div><div class=footer><p>tail</p></div>"
    assert html_blocks.main_text(page) == f"{long}\nShort one\n{long}"


def test_templates_catch_changed_numbers_and_check_slots(spark):
    item = "A train leaves at 7 hours and carries 120 passengers, then 120 passengers leave after 45 km of track, how far does it go"
    changed = item.replace("120", "377").replace("45", "81")
    mixed = item.replace("120 passengers, then 120", "5 passengers, then 99").replace("7", "5").replace("45", "5")
    clean = "A recipe of the day asks for 2 spoons of flour and 3 eggs, which are mixed for 10 minutes in a large bowl before baking"
    docs = spark.createDataFrame([(1, "Before it. " + item + " and after"), (2, "Quiz: " + changed), (3, clean), (4, None), (5, mixed)], "doc_id long, text string")
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    rows = {r["doc_id"]: r for r in decontamination.contaminated(docs, bench).collect()}
    assert {1, 2} <= set(rows) and 3 not in rows and rows[1]["changed_slots"] == 0 and rows[2]["changed_slots"] == 3


def test_slots_map_one_to_one_at_some_placement(spark):
    item = "A train leaves at 7 hours and carries 120 passengers, then 120 passengers leave after 45 km of track, how far does it go"
    mixed = item.replace("120 passengers, then 120", "5 passengers, then 99").replace("7", "5").replace("45", "5")
    back = item.replace("45", "120")
    far = " ".join(f"filler{i}" for i in range(80))
    inserted = item.replace("then", "and a little later then").replace("120", "33")
    texts = {5: mixed, 6: back, 7: f"{back} {far} {item}", 8: f"{item} {far} {mixed}", 9: f"{mixed} {item}", 10: inserted, 11: item.replace("km", "miles")}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in decontamination.contaminated(docs, spark.createDataFrame([("q", item)], "item_id string, text string")).collect()}
    assert sorted(rows) == [7, 8, 9, 10, 11] and rows[7]["changed_slots"] == rows[8]["changed_slots"] == rows[9]["changed_slots"] == 0


def test_short_items_and_scripts_without_spaces(spark):
    bench = {"sum": "What is 12 + 7?", "part": "What is 12.5 + 7?", "zh": "小明有十二个苹果，他吃了三个，还剩几个？", "th": "แมวตัวนี้กินปลากี่ตัวในหนึ่งวัน", "zh2": "几点了", "none": "?!", "null": None}
    texts = {
        1: "A quiz: what is 12 + 7? Nobody knows", 2: "A quiz: what is 12 + 8? Nobody knows", 3: "what is 12.5 + 7", 4: "前面的话。小明有十二个苹果,他吃了三个,还剩几个?后面的话。", 5: "天气很好，我们去公园玩，大家都很高兴。",
        6: "ก่อน แมวตัวนี้กินปลากี่ตัวในหนึ่งวัน หลัง", 7: "现在几点了呢", 8: "what is 12", 9: None,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame(list(bench.items()), "item_id string, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items).collect()} == {(1, "sum"), (3, "part"), (4, "zh"), (6, "th"), (7, "zh2")}
    assert sorted(r["doc_id"] for r in decontamination.without_leaks(docs, items).collect()) == [2, 5, 8, 9]


def test_splitting_common_windows_changes_nothing(spark, sf_dir, monkeypatch):
    before = sorted(QUERIES["op7_decontamination"](spark, sf_dir).collect(), key=str)
    monkeypatch.setattr(decontamination, "LISTED", 1)
    assert sorted(QUERIES["op7_decontamination"](spark, sf_dir).collect(), key=str) == before and before


def test_exact_benchmark_passages_are_found(spark, sf_dir):
    squeeze = lambda t: " ".join(t.lower().split())
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    bench = pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist()
    held = {(d["doc_id"], b["item_id"]) for d in docs for b in bench if d["text"] and squeeze(b["text"]) in squeeze(d["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op7_decontamination"](spark, sf_dir).collect()}
    assert held and held <= got


@given(st.lists(st.integers(1, 40), max_size=9))
@settings(max_examples=60, deadline=None)
def test_bin_completion_is_optimal_on_small_lists(sizes):
    capacity, counts = 40, {s: sizes.count(s) for s in sizes}
    found = packing.bin_completion(counts, capacity)
    assert sorted(s for t, f in found for _ in range(t) for s in f) == sorted(sizes)
    assert all(sum(f) <= capacity for _, f in found)

    def fits(bins):
        room = [capacity] * bins
        order = sorted(sizes, reverse=True)

        def place(k):
            if k == len(order):
                return True
            for b in {room[b]: b for b in range(bins)}.values():
                if room[b] >= order[k]:
                    room[b] -= order[k]
                    if place(k + 1):
                        return True
                    room[b] += order[k]
            return False

        return place(0)

    assert sum(t for t, _ in found) == next(b for b in itertools.count() if fits(b))


@given(st.binary(max_size=700))
@settings(max_examples=60, deadline=None)
def test_jpeg_round_trip(raw):
    payload = media.payload_of(raw)
    (head, coef), (again, _) = media.decode([media.encode(payload), media.encode(bytes(64))])
    assert media.payload_back(head, coef) == payload and again.blocks == 1
    small = media.thumbnail(head, coef)
    assert small.size == head.blocks and head.width % 8 == 0 and re.fullmatch("[0-9a-f]{16}", media.thumbnail_hash(small))


@given(st.lists(st.text(alphabet="ab \t\n\x0bé漢", max_size=30), max_size=6), st.integers(1, 4))
@settings(max_examples=80, deadline=None)
def test_words_and_windows(texts, n):
    found = words.split(pa.array(texts, pa.string()))
    expected = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert found.counts().tolist() == [len(w) for w in expected]
    flat = [w for ws in expected for w in ws]
    h = found.hashes()
    assert len(set(h.tolist())) == len(set(flat))
    w = words.windows(h, n)
    assert len(set(w.tolist())) == len({tuple(flat[i : i + n]) for i in range(len(flat) - n + 1)})


def swapped_words(n):
    """The Thue-Morse word of n letters and the same with its letters swapped."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_structured_words_differ(spark):
    """Words that agree in every polynomial hash modulo a power of two."""
    pairs = [swapped_words(n) for n in (8, 16, 32, 64, 1024, 2048, 4096)]
    flat = [w for pair in pairs for w in pair]
    for seed in (0, 1):
        assert len(set(words.split(pa.array(flat)).hashes(seed=seed).tolist())) == len(flat)
    tok = tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    ids, at = tok.encode(pa.array(flat))
    for i, w in enumerate(flat):
        assert ids[at[i] : at[i + 1]].tolist() == [*tok.tokenizer.encode(w, add_special_tokens=False).ids, 0]
    lead = " ".join(f"w{k}" for k in range(17))
    rows = [(2 * k + j, f"{lead} {pair[j]} {lead[::-1]}") for k, pair in enumerate(pairs) for j in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r["n_removed"] == 0 for r in without_repeats(docs).collect())
    short = spark.createDataFrame([(2 * k + j, f"x {pair[j]} y z") for k, pair in enumerate(pairs) for j in (0, 1)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in with_component_ids(near_duplicates(short, 3, 90, 100)).collect()} == {k: k for k in range(2 * len(pairs))}


def test_covers_take_any_two_positions_to_anchors():
    for period, cover in repeats.COVERS.items():
        anchors = {x for x in range(period) if x in cover}
        assert all(any((a + k) % period in anchors and (b + k) % period in anchors for k in range(period)) for a in range(period) for b in range(period))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (7, 7), (200, 205), (205, 203)]
    got = {(r["id"], r["root"]) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(31)} | {(100, 100), (101, 100), (200, 200), (203, 200), (205, 200)}


def test_components_of_a_hub(spark):
    """A node of more edges than one part holds, and nodes that a chain ties to it."""
    rows = [(500 + k, 500) for k in range(1, 400)] + [(500, 7), (7, 3), (2, 1)]
    found = {r["id"]: r["root"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert found == {k: 1 if k < 3 else 3 for row in rows for k in row}


def test_join_spreads_frequent_keys(spark):
    rows = [(1, "same")] * 250 + [(k, None) for k in range(150)] + [(k, f"k{k}") for k in range(30)] + [(5, "lone")]
    side = spark.createDataFrame([("same", 10), ("k3", 11), ("unused", 12)], "key string, value int")
    joined = join_hot(keep(spark.createDataFrame(rows, "id int, key string"), "rows"), side, "key")
    assert joined.columns == ["id", "key", "value"]
    got = Counter(tuple(r) for r in joined.collect())
    assert got == Counter((i, k, {"same": 10, "k3": 11}.get(k)) for i, k in rows)


def test_frequent_texts(spark):
    """Copies, near copies and empty texts beyond the count from which keys are spread."""
    words = [f"w{i}" for i in range(80)]
    rows = [(k, " ".join(words)) for k in range(10, 260)] + [(k, " ".join([*words[:-1], f"x{k}"])) for k in range(300, 420)]
    rows += [(k, None if k % 2 else "") for k in range(500, 720)] + [(5, " ".join([*words, "end"])), (6, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in with_component_ids(near_duplicates(docs, 3, 90, 100)).collect()}
    assert found == {d: (0, d) if d >= 500 else (1, 6) if d == 6 else (len((t or "").split()) - 2, 5) for d, t in rows}
    assert {r["doc_id"] for r in one_of_each(docs, 3, 90, 100).collect()} == {5, 6, *range(500, 720)}
    removed = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in without_repeats(docs).collect()}
    assert removed == {d: (0, 0) if d >= 500 else (1, 0) if d == 6 else (81, 80) if d == 5 else (80, 80) if d < 300 else (80, 79) for d, t in rows}


def test_label_model_outweighs_noisy_labels():
    rng = np.random.default_rng(3)
    truth = rng.random(2000) < 0.3
    vote = lambda right: np.where(rng.random(2000) < right, truth, ~truth) * 2 - 1
    votes = np.column_stack([vote(0.9), vote(0.85), vote(0.9), vote(0.85), vote(0.8)]).astype(np.int8)
    post = label_model(votes) > 0.5
    assert (post == truth).mean() > 0.95 > ((votes[:, -1] > 0) == truth).mean() + 0.1


def area(score, label):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1.0
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    n1 = label.sum()
    return (rank[label].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_label_model_pairs_voters_that_go_together():
    """Three copies of one poor voter don't outvote two good ones."""
    rng = np.random.default_rng(4)
    truth = rng.random(3000) < 0.4
    vote = lambda right: np.where(rng.random(3000) < right, truth, ~truth) * 2 - 1
    poor = vote(0.65)
    same = [np.where(rng.random(3000) < 0.98, poor, -poor) for _ in range(3)]
    votes = np.column_stack([*same, vote(0.9), vote(0.88), vote(0.85)]).astype(np.int8)
    pairs = forest(votes, truth.astype(float))
    assert len([1 for i, j in pairs if i < 3 and j < 3]) == 2
    assert ((label_model(votes) > 0.5) == truth).mean() > 0.9


def test_findings_of_the_voters():
    texts = ["you are such an idiot", "I will kill you", "what an 1d1ot, a stuuupid one", "IDIOT AND MORON!!", "idiot", "the house is old", "", "Trottel"]
    found = findings(words.split(pa.array(texts), words.NOT_LETTERS))
    names = [{n for n, f in zip(FINDINGS, row, strict=True) if f} for row in found]
    assert "addressed" in names[0] and "threat" in names[1] and "disguised" in names[2]
    assert {"several", "shouted", "exclaimed"} <= names[3] and names[5] == names[6] == set() and "insults de" in names[7]


@pytest.mark.parametrize(
    ("name", "column", "scale", "least", "found", "wrong"),
    [("op5_toxicity", "toxic", 0.1, 0.95, 0.9, 0.02), ("op5_toxicity", "toxic", 0.01, 0.75, 0.6, 0.02), ("op6_quality_classifier", "quality", 0.01, 0.95, 0.95, 0.05)],
)
def test_held_out_accuracy(spark, name, column, scale, least, found, wrong):
    sf = SF.format(scale)
    labels = {r["doc_id"]: r[column] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist() if r[column] is not None}
    rows = [r for r in QUERIES[name](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    label = np.array([labels[r["doc_id"]] == 1 for r in rows])
    predicted = np.array([r["predicted"] == 1 for r in rows])
    assert label.any() and not label.all()
    assert area(np.array([r["score"] for r in rows]), label) >= least
    assert predicted[label].mean() >= found and predicted[~label].mean() <= wrong


def test_pipeline_decisions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    sets = {}
    for r in kept.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    pairs = itertools.combinations([s for s in sets.values() if s], 2)
    assert not [1 for a, b in pairs if 100 * len(a & b) >= 80 * len(a | b)]
    clean = corpus_pipeline.redact_secrets(spark, kept, sf_dir).collect()
    assert len(clean) == kept.count() and not any(secret_scan.scan(r["text"] or "") for r in clean)
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert out and {r["doc_id"] for r in out} <= set(sets)
