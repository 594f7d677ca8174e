"""The manifest, reply trees and periodic runs against plain versions, SQL and odd rows."""

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdictspark.llm import jaccard, merkle, queries, repeats, reply_trees, runs
from verdictspark.llm.words import split
from tests.llm.test_brute_force import components_of, shingles
from tests.llm.test_edges import DOCS, LONG, TALKS, nothing, odd  # noqa: F401


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def low(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_tree(digests):
    out = [digests]
    while len(digests) > 1:
        digests = [sha("".join(digests[i : i + 8])) for i in range(0, len(digests), 8)]
        out.append(digests)
    return out


def plain_manifest(rows):
    """Sorted result rows of the contract, each proof walked by itself."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    leaf = lambda r: sha("".join(encoded(r[f]) for f in fields))
    groups = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))):
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [plain_tree([leaf(r) for r in groups[g]]) for g in langs]
    top = plain_tree([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            now, siblings = leaf(r | {"text": low(r["text"])}) if bad else leaf(r), ""
            for tree, at in ((trees[k], i), (top, k)):
                for level in tree[:-1]:
                    first = at - at % 8
                    before, behind = "".join(level[first:at]), "".join(level[at + 1 : first + 8])
                    siblings, now, at = siblings + before + behind, sha(before + now + behind), at // 8
            out.append((r["doc_id"], leaf(r), trees[k][-1][0], top[-1][0], sha(siblings), now, now == top[-1][0]))
    return sorted(out, key=str)


def checked_manifest(spark, where):
    rows = pq.read_table(f"{where}/documents.parquet", columns=["doc_id", "source", "lang", "n_chars", "text"]).to_pylist()
    got = sorted((tuple(r) for r in queries.QUERIES["op11_merkle_manifest"](spark, where).collect()), key=str)
    assert got == plain_manifest(rows)
    con = duckdb.connect()
    path = pq.ParquetDataset(f"{where}/documents.parquet").files
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet({path})")
    assert sorted(con.execute(queries.ORACLES["op11_merkle_manifest"]).fetchall(), key=str) == got
    return got


def test_manifest(spark, sf_dir):
    got = checked_manifest(spark, sf_dir)
    assert len(got) == 200 and any(not r[-1] for r in got)


def test_manifest_of_odd_rows(spark, odd):
    got = checked_manifest(spark, odd)
    assert len(got) == len(DOCS) and len({r[1] for r in got if r[0] == 6}) == 1


def test_manifest_of_many_groups(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"T{i} Ä", rng.choice([None, "", "x", *map(str, range(70))]) if i > 600 else "hot", "s", i) for i in range(900)]
    rows += [(5, "twice", "one", "s", 1)] * 2 + [(7, "alone", "é", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    checked_manifest(spark, str(tmp_path))


def test_other_fanouts(spark):
    docs = spark.range(30).selectExpr("id AS k", "concat('v', id) AS v", "'g' AS g")
    rows = merkle.manifest(docs, ["v"], "g", "k", 3).withColumn("again", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert {r["again"] for r in rows} == {rows[0]["root"]} and {len(r["path"]) for r in rows} == {4}


def plain_talks(rows):
    talks = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn, role or "", text or ""))
    out = []
    for conv, turns in talks.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(learnt), sha(learnt)))
    return sorted(out, key=str)


@pytest.mark.parametrize("table", ["given", "odd"])
def test_talks(spark, sf_dir, odd, table):  # noqa: F811
    where = sf_dir if table == "given" else odd
    rows = [r[:4] for r in TALKS] if table == "odd" else [tuple(r.values()) for r in pq.read_table(f"{where}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    got = sorted((tuple(r) for r in queries.QUERIES["op12_chat_formatting"](spark, where).collect()), key=str)
    assert [r[:5] for r in got] == plain_talks(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet({pq.ParquetDataset(f'{where}/conversations.parquet').files})")
    assert sorted(con.execute(queries.ORACLES["op12_chat_formatting"]).fetchall(), key=str) == got


def plain_branches(rows, most):
    """Formatted turns of each root's best branches: all paths, one by one."""
    by_id = {r[0]: r for r in rows}
    replied = {r[1] for r in rows if r[1] in by_id}
    trees = {}
    for r in rows:
        if r[0] not in replied:
            path = [r]
            while path[0][1] in by_id:
                path.insert(0, by_id[path[0][1]])
            trees.setdefault(path[0][0], []).append((-sum(p[4] or 0 for p in path), r[0], [(p[2] or "", p[3] or "") for p in path]))
    return {(root, leaf, k + 1): (-score, turns) for root, found in trees.items() for k, (score, leaf, turns) in enumerate(sorted(found)[:most])}


CONTROLS = ["</s>", "<s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[/TURN]", "<\\s>", "[\\\\/INST]", "<", "[", "\\", "s>", "INST]", "<<s>", "$1", "é𝄞", "\n", " "]


def test_reply_trees(spark):
    rng = random.Random(4)
    text = lambda: rng.choice([None, "".join(rng.choices(CONTROLS, k=rng.randrange(12)))])
    rows = []
    for i in range(400):
        parent = None if i == 0 or rng.random() < 0.05 else f"m{rng.randrange(max(0, i - 30), i)}" if rng.random() < 0.97 else "gone"
        rows.append((f"m{i}", parent, rng.choice(["system", "user", "assistant", "tool", "[/ROLE]", None]), text(), rng.choice([None, 0.5, 1.0, -2.0])))
    # A long chain that replies to the last one.
    rows += [(f"n{i:03}", f"n{i - 1:03}" if i else "m399", "user" if i % 2 else "assistant", text(), 1.0) for i in range(150)]
    messages = spark.createDataFrame(rows, "id string, parent string, role string, text string, score double")
    out = reply_trees.conversations(messages, 3)
    out = out.withColumn("turns", reply_trees.parsed(F.col("formatted"))).withColumn("said", reply_trees.learnt(F.col("formatted"), F.col("loss")))
    got = {(r["root"], r["leaf"], r["rank"]): r for r in out.collect()}
    want = plain_branches(rows, 3)
    assert got.keys() == want.keys()
    for at, (score, turns) in want.items():
        assert got[at]["score"] == pytest.approx(score)
        assert [tuple(t) for t in got[at]["turns"]] == turns
        assert got[at]["said"] == "".join(t for r, t in turns if r == "assistant")
        assert got[at]["formatted"].count("<s>") == sum(r == "assistant" for r, _ in turns)


def test_rings_and_repeated_ids_are_refused(spark):
    kind = "id string, parent string, role string, text string"
    with pytest.raises(ValueError, match="ring"):
        reply_trees.paths(spark.createDataFrame([("a", "b", "", ""), ("b", "c", "", ""), ("c", "a", "", ""), ("d", None, "", "")], kind), score=None)
    with pytest.raises(ValueError, match="unique"):
        reply_trees.paths(spark.createDataFrame([("a", None, "", ""), ("a", None, "", "")], kind), score=None)


def plain_runs(seq, least=24, exponent=3):
    """Each period by itself: maximal stretches in which words that far apart agree; the smallest period of a stretch counts."""
    out = {}
    for q in range(1, len(seq) // exponent + 1):
        i = 0
        while i + q < len(seq):
            j = i
            while j + q < len(seq) and seq[j] == seq[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((a, n, q) for (a, n), q in out.items())


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_runs_of_small_alphabets(data):
    seq = []
    for step in data.draw(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 12), st.integers(0, 4)), max_size=14)):
        kind, size, times = step
        seq += [kind] if times == 0 or not seq else seq[-size:] * times
    seq = seq[:300]
    for least, exponent in ((1, 2), (1, 3), (24, 3), (9, 4)):
        assert runs.runs_of(seq, least, exponent) == plain_runs(seq, least, exponent)
        assert runs.text_runs([b"w%d" % k for k in seq], least, exponent) == plain_runs(seq, least, exponent)


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    numbers = {w: k for k, w in enumerate(set(words))}
    found = plain_runs([numbers[w] for w in words]) if n < 3000 else runs.text_runs(words)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in sorted(found, key=lambda r: (r[0], r[2])))
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(lines), hashlib.sha256(left).hexdigest())


@pytest.mark.parametrize("table", ["given", "odd"])
def test_runs(spark, sf_dir, odd, table):  # noqa: F811
    where = sf_dir if table == "given" else odd
    docs = pq.read_table(f"{where}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = sorted((tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, where).collect()), key=str)
    assert got == sorted((plain_row(r["doc_id"], r["text"]) for r in docs), key=str)
    assert table == "odd" or any(r[1] for r in got)


def test_runs_of_texts_in_a_table(spark):
    texts = ["a " * 30, "x y z " * 9 + "tail", "a b " * 12 + "c " + "a b " * 12 + "c " + "a b " * 12 + "c", "u " * 23, LONG]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in runs.periodic_runs(docs).collect()}
    assert [[tuple(r) for r in got[i]["runs"]] for i in range(5)] == [[(0, 30, 1)], [(0, 27, 3)], [(0, 24, 2), (0, 75, 25), (25, 24, 2), (50, 24, 2)], [], []]
    assert got[0]["collapsed"] == "a" and got[1]["collapsed"] == "x y z tail" and got[2]["collapsed"] == "a b c" and got[4]["collapsed"] == LONG


def test_long_runs_take_time_in_proportion():
    a, b = [0], [0, 1]
    while len(b) < 100_000:
        a, b = b, b + a
    assert len(runs.runs_of(b)) > 5_000 and runs.runs_of([7] * 300_000) == [(0, 300_000, 1)]


#: Words that one chain over their bytes can't tell apart, and words of other lengths.
ALIKE = ["abcdefghijklmnop", "o2zbyr6z%>4':}{h", "abcdefgh", "abcdefg", "abcdefghi", "a", "aa", "aaaaaaaa", "aaaaaaaaaaaaaaaa", "x" * 32, "x" * 33, "é" * 16]


def test_words_keep_their_own_hashes():
    words = split(pa.array([" ".join(ALIKE)]))
    for seed in (0, 1, 2):
        assert len(set(words.hashes(seed=seed).tolist())) == len(ALIKE)
    assert not set(words.hashes(seed=0).tolist()) & set(words.hashes(seed=1).tolist())


def test_alike_words_neither_link_nor_repeat(spark):
    side = [f"w{k}" for k in range(40)]
    texts = [" ".join([*side[:20], w, *side[20:]]) for w in ALIKE[:3]]
    docs = spark.createDataFrame(list(enumerate([f"x {w} y z" for w in ALIKE])), "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard.with_component_ids(jaccard.near_duplicates(docs, 3, 90, 100)).collect()} == {(i, i) for i in range(len(ALIKE))}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r["doc_id"], r["n_removed"]) for r in repeats.without_repeats(docs, 35).collect()} == {(0, 0), (1, 0), (2, 0)}


def test_a_shingle_in_a_tenth_of_all_texts(spark):
    """Buckets get a frequent token once a chunk or block, and links stay what they are."""
    rng = random.Random(8)
    texts = []
    for i in range(600):
        own = [f"v{rng.randrange(9000)}" for _ in range(rng.randint(4, 40))]
        texts.append(" ".join((["hot", "line", "here"] if i % 10 == 0 else []) + own))
        if i % 50 == 0:
            texts.append(texts[-1] + " more" if i % 100 else texts[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.with_component_ids(jaccard.near_duplicates(docs, 3, 90, 100)).collect()}
    sets = {i: shingles(t, 3) for i, t in enumerate(texts)}
    assert got == components_of(sets, 90, 100)
    run = jaccard._sampled(3, (1 << 64) - 1, 4)
    batch = pa.RecordBatch.from_pydict({"text": texts})
    rows = [r for b in run(iter([batch])) for r in b.to_pylist()]
    places = sum(len(r["tokens"]) // 4 for r in rows if r["tokens"] is not None)
    assert places <= len(set().union(*sets.values()))
