"""The whole pipeline, and decontamination over tables, against plain versions that look at all pairs."""

import random
import re
import tracemalloc
import zlib

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from verdictspark.llm import decontamination, secret_scan, toxicity
from verdictspark.llm.words import NOT_LETTERS, split

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables(sf_dir):
    read = lambda name: pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()
    return read("documents"), read("benchmark")


def holds(text, item):
    """Whether a text holds an item, tested alone."""
    bench = decontamination.benchmark_of([0], pa.array([item], pa.string()), decontamination.WINDOW)
    return any(decontamination.leaks(decontamination.templates(pa.array([text], pa.string())), bench, decontamination.WINDOW, decontamination.SHARE))


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def one_of_each(docs):
    """The least id of each component of sets 80 % alike, and all without a set."""
    sets = {d["doc_id"]: shingles(d["text"]) for d in docs}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [d for d in docs if not sets[d["doc_id"]] or find(d["doc_id"]) == d["doc_id"]]


def test_the_pipeline_agrees_with_plain_stages(spark, sf_dir, tables):
    docs, items = tables
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(frame, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = model.score(split(pa.array([d["text"] or "" for d in docs]), NOT_LETTERS))
    left = one_of_each([d for d, s in zip(docs, score, strict=True) if s < 0.5])
    assert len(left) < len(docs)
    clean = [d for d in left if not any(b["text"] and holds(d["text"] or "", b["text"]) for b in items)]
    assert len(clean) < len(left)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = set()
    for d in clean:
        text = d["text"] or ""
        ids = [*tok.encode(secret_scan.redact(text, secret_scan.scan(text)), add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            expected.add((d["doc_id"], k // 2048, len(ids[k : k + 2048]), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[k : k + 2048]))))
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert len(out) == len(expected) and {(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in out} == expected
    places: dict[int, list] = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_the_window_join_loses_no_pair(spark, sf_dir, tables):
    docs, items = tables
    expected = {(d["doc_id"], b["item_id"]) for d in docs for b in items if d["text"] and b["text"] and holds(d["text"], b["text"])}
    frame = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(frame("documents"), frame("benchmark")).collect()}
    assert got == expected and expected


NAMES = "Alice Bruno Carla Dmitri Elena Farid Greta Hiro Ines Jonas".split()
UNITS = "km miles kg litres hours minutes".split()
SHAPES = (
    "Yesterday {n} walked {a} {u} along the river and then {n} rested before walking another {b} {u} back to the old mill",
    "A crate holds {a} apples and the shop of {n} orders {b} crates every morning so how many apples does {n} receive in {a} mornings",
    "When {n} mixes {a} {u} of sand with {b} {u} of gravel the mixture fills the wheelbarrow which {n} empties {a} times",
    "The tank loses {a} {u} each day while {n} refills it with {b} {u} so after how many days does {n} find it full again",
)


def test_re_parameterised_items_are_found_and_mixed_ones_refused(spark):
    rng = random.Random(11)
    values = lambda: {"n": rng.choice(NAMES), "a": rng.randint(2, 99), "b": rng.randint(100, 999), "u": rng.choice(UNITS)}
    items, docs, planted, mixed = [], [], set(), set()
    words = [f"filler{k}" for k in range(200)]
    around = lambda: " ".join(rng.choices(words, k=rng.randint(0, 60)))
    for k in range(24):
        tail = f" while the {words[k]} and the {words[k + 40]} wait near the {words[k + 80]}"
        shape = SHAPES[k % 4] + tail
        own = values()
        items.append((f"q{k}", shape.format(**own)))
        for _ in range(3):
            docs.append((len(docs), f"{around()} {shape.format(**values())} {around()}"))
            planted.add((docs[-1][0], f"q{k}"))
        # One name stands for two, or two numbers for one.
        other = values()
        odd = shape.replace("{n}", other["n"], 1).format(**other | {"n": next(x for x in NAMES if x != other["n"])})
        odd = odd if shape.count("{n}") > 1 and k % 4 else shape.format(**other | {"b": other["a"]})
        docs.append((len(docs), f"{around()} {odd} {around()}"))
        mixed.add(docs[-1][0])
    clean = [(len(docs) + k, " ".join(rng.choices(words, k=80))) for k in range(40)]
    frame = spark.createDataFrame(docs + clean, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(frame, spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert len(planted & got) >= 0.9 * len(planted)
    assert not {d for d, _ in got} & mixed and not {d for d, _ in got} & {i for i, _ in clean}
    assert all((d, i) in planted or holds(dict(docs)[d], dict(items)[i]) for d, i in got)


NUMBERS = "two three four five six seven eight nine ten eleven twelve fifteen nineteen thirty forty-two seventy-seven ninety".split()
KINDS = {
    # Few of the windows are free of names.
    "openers": (
        "{n} owns {a} goats. {m} sells {b} goats. {n} buys {c} hens. {m} feeds the hens. {n} counts them all. {m} closes the gate. {n} goes home. {m} stays.",
        "{m} bakes {a} loaves. {n} carries {b} loaves. {m} eats {c} loaves. {n} drinks the milk. {m} sweeps the floor. {n} rests. {m} sings.",
    ),
    "words": (
        "a farmer keeps {x} cows and {y} hens in the yard while {z} sheep graze on the hill above the barn all summer",
        "the class has {x} rows of desks and each row seats {y} pupils but only {z} pupils came on that rainy day",
    ),
    "units": (
        "the barrel holds {a} {u} when the pump starts and loses {b} {u} before the keeper closes the last valve of the line",
        "a rope of {a} {u} is cut so that {b} {u} stay on the drum and the rest goes to the boat at the pier",
    ),
    "lists": (
        "the dice show {a} {b} {c} in the first throw of the game and the clerk writes {a} {b} {c} into the green book",
        "sort the keys {a} {b} {c} into a heap and print {c} {b} {a} after the last step of the loop has ended",
    ),
}


def test_recall_by_kind_of_slot(spark):
    rng = random.Random(23)
    measures = "gallons pounds inches feet yards ounces cups tonnes litres pints".split()

    def values():
        n, m = rng.sample(NAMES, 2)
        x, y, z = rng.sample(NUMBERS, 3)
        a, b, c = rng.sample(range(2, 400), 3)
        return {"n": n, "m": m, "x": x, "y": y, "z": z, "a": a, "b": b, "c": c, "u": rng.choice(measures)}

    items, docs, planted, mixed = [], [], {k: set() for k in KINDS}, set()
    # Of letters alone: a digit in a filler word would be a number slot that another value may meet.
    filler = ["".join(rng.choices("bdfglmnprst", k=3)) + "".join(rng.choices("aeiou", k=2)) + x for x in "klmnprstvz" for _ in range(20)]
    around = lambda: " ".join(rng.choices(filler, k=rng.randint(0, 40)))
    for kind, shapes in KINDS.items():
        for k in range(10):
            shape = shapes[k % 2] if kind == "openers" else f"{shapes[k % 2]} the {filler[k]} and the {filler[k + 50]} stay by the {filler[k + 90]}"
            items.append((f"{kind}{k}", shape.format(**values())))
            for _ in range(4):
                docs.append((len(docs), f"{around()}. {shape.format(**values())} {around()}"))
                planted[kind].add((docs[-1][0], f"{kind}{k}"))
            if kind == "lists":
                docs.append((len(docs), f"{around()}. {shape.replace('{c}', '{a}', 1).format(**values())} {around()}"))
                mixed.add(docs[-1][0])
            if kind == "openers" and k % 2 == 0:
                # Both people become one.
                docs.append((len(docs), f"{around()}. {shape.replace('{m}', '{n}').format(**values())} {around()}"))
                mixed.add(docs[-1][0])
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(frame, spark.createDataFrame(items, "item_id string, text string")).collect()}
    recall = {kind: len(own & got) / len(own) for kind, own in planted.items()}
    print(recall)
    assert min(recall.values()) >= 0.9, recall
    assert not {d for d, _ in got} & mixed


def test_repeated_windows_against_a_long_text_of_numbers_stay_small():
    rng = random.Random(5)
    text = " ".join(str(rng.randint(1, 10**6)) for _ in range(400_000))
    bench = decontamination.benchmark_of([0], pa.array([" ".join(str(rng.randint(1, 10**6)) for _ in range(100))]), 5)
    template = decontamination.templates(pa.array([text]))
    assert len(bench.hashes) == 1 and int((bench.begins == 0).sum()) == 96
    tracemalloc.start()
    found = list(decontamination.leaks(template, bench, 5, 0.5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 1 and peak < 100 * len(text)


def test_item_blocks_change_nothing(tables, monkeypatch):
    docs, items = tables
    column, texts = pa.array([d["text"] or "" for d in docs]), [b["text"] or "" for b in items]
    found = lambda: set(map(str, decontamination.leaks(decontamination.templates(column), decontamination.benchmark_of(list(range(len(texts))), pa.array(texts), 5), 5, 0.5)))
    before = found()
    monkeypatch.setattr(decontamination, "BLOCK", 7)
    assert found() == before and before
