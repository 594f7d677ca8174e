"""Each operator's query against a plain version of its contract on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from verdictspark.llm import queries
from verdictspark.llm.jaccard import near_duplicates
from verdictspark.llm.sharding import CapacityTree, best_fit_decreasing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(sf_dir):
    rows = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def rows_of(spark, sf_dir, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, sf_dir).collect()]


def fold_case(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text, n):
    words = WORD.findall(fold_case(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def components_of(sets, num, den):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_secret_spans(spark, sf_dir, texts):
    assign = re.compile(r"""(?a)((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = {r["doc_id"]: r for r in rows_of(spark, sf_dir, "op1_secret_scan")}
    assert set(found) == set(texts)
    for doc, text in texts.items():
        spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(text) if len(m[2]) >= 12]
        spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        base = [s for _, _, s in sorted(spans)]
        r = found[doc]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(",")) | {""}


def test_packing_round_trip(spark, sf_dir, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows_of(spark, sf_dir, "op2_best_fit_packing"):
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    total = 0
    for doc, text in texts.items():
        ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
        total += len(ids)
        cut = [ids[a : a + 2048] for a in range(0, len(ids), 2048)]
        own = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in own] == [(k, 2048 * k, len(c)) for k, c in enumerate(cut)]
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(b"".join(i.to_bytes(4, "little") for i in c)) for c in cut]
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= -(-total // 2048) + 2


def test_jaccard_components(spark, sf_dir, texts):
    sets = {d: shingles(t, 3) for d, t in texts.items()}
    expected = components_of(sets, 90, 100)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(spark, sf_dir, "op3_ngram_jaccard_join")}
    assert got == {d: (len(sets[d]), expected[d]) for d in texts}
    assert len(set(expected.values())) < len(expected)


def test_jaccard_on_close_sets(spark):
    """Chains, subsets and sets on either side of the threshold."""
    words = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(words))]
    rows += [(k, " ".join([*words[:-k], *(f"x{k}_{j}" for j in range(k))])) for k in range(1, 12)]
    rows += [(20 + k, " ".join(words[k:])) for k in range(1, 15)]
    rows += [(40, "a b c"), (41, "A B C"), (42, "a b"), (43, "a  b"), (44, ""), (45, None)]
    for n, num in ((3, 90), (5, 80), (1, 50)):
        sets = {d: shingles(t or "", n) for d, t in rows}
        found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n, num, 100).collect()
        groups = defaultdict(set)
        for r in found:
            groups[r["component"] if r["component"] is not None else ("own", r["doc_id"])].add(r["doc_id"])
        expected = defaultdict(set)
        for d, c in components_of(sets, num, 100).items():
            expected[c].add(d)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_repeats(spark, sf_dir, texts):
    n = 35
    split = {d: WORD.findall(t) for d, t in texts.items()}
    times = Counter(tuple(w[i : i + n]) for w in split.values() for i in range(len(w) - n + 1))
    got = {r["doc_id"]: r for r in rows_of(spark, sf_dir, "op10_substring_dedup")}
    removed = 0
    for doc, words in split.items():
        gone = set()
        for i in range(len(words) - n + 1):
            if times[tuple(words[i : i + n])] > 1:
                gone.update(range(i, i + n))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        removed += len(gone)
        assert (got[doc]["n_words"], got[doc]["n_removed"]) == (len(words), len(gone))
        assert got[doc]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert removed


def test_media(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in rows_of(spark, sf_dir, "op8_media_columns")}
    by_text = {}
    for doc, text in texts.items():
        raw = text.encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[doc]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert by_text.setdefault(text, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def test_shards(spark, sf_dir, texts):
    rows = rows_of(spark, sf_dir, "op9_sharding")
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    of_text, slots, sizes = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        of_text[texts[r["doc_id"]]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in of_text.values())
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= max(len(t.encode()) + 1 for t in texts.values())


def test_best_fit_decreasing_matches_a_list_of_bins():
    classes = [(k, s, n) for k, (s, n) in enumerate([(70, 3), (51, 5), (33, 9), (20, 7), (9, 30), (3, 11)])]
    room = []
    for _, size, count in sorted(classes, key=lambda c: -c[1]):
        for _ in range(count):
            fits = [b for b in range(len(room)) if room[b] >= size]
            if fits:
                b = min(fits, key=lambda b: room[b])
            else:
                room.append(100)
                b = len(room) - 1
            room[b] -= size
    runs = best_fit_decreasing(classes, 100)
    assert len({r[3] for r in runs}) == len(room)
    assert sum(hi - lo for _, lo, hi, _ in runs) == sum(n for _, _, n in classes)
    tree = CapacityTree()
    for k, remaining in enumerate((5, 9, 7, 7)):
        tree.insert(remaining, k)
    assert [tree.take_tightest(6), tree.take_tightest(6), tree.take_tightest(6), tree.take_tightest(6)] == [(7, 2), (7, 3), (9, 1), None]
