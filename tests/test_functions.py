"""Edge cases of parsing, claims, prompts and fault validation."""

import json

import pytest
from pyspark.sql import functions as F

from verdictspark.operators import postings
from verdictspark.functions import audits, claims, faults, prompts

GOOD = {"verdict": "incorrect", "first_error_step": 2, "confidence": 0.5, "error_type": "logical", "evidence": "x"}


def _audit(spark, raw, n=4):
    row = spark.createDataFrame([(raw,)], "raw string").select(audits.parse_audit(F.col("raw"), F.lit(n)).alias("a")).first()
    return row["a"]


@pytest.mark.parametrize(
    "raw",
    ["garbage", "[]", "", json.dumps(GOOD | {"verdict": "maybe"}), json.dumps(GOOD | {"confidence": 1.5}), json.dumps(GOOD | {"confidence": None}), json.dumps(GOOD | {"confidence": True}),
     json.dumps(GOOD | {"confidence": "0.5"}), json.dumps(GOOD | {"evidence": 42}), json.dumps(GOOD) + " trailing", json.dumps(GOOD) + "," + json.dumps(GOOD), json.dumps(GOOD) + "],[{}", "null", None],
)
def test_refused_audits(spark, raw):
    assert _audit(spark, raw) is None


@pytest.mark.parametrize("step", [None, 0, 5, -1, True, "2", 2.0])
def test_unusable_steps_keep_the_verdict(spark, step):
    a = _audit(spark, json.dumps(GOOD | {"first_error_step": step}))
    assert a["verdict"] == "incorrect" and a["first_error_step"] is None and not a["localization_usable"] and a["reported_error"]


def test_sound_audits(spark):
    a = _audit(spark, json.dumps(GOOD | {"extra": [1]}))
    assert (a["first_error_step"], a["error_type"], a["localization_usable"]) == (2, "logical", True)
    b = _audit(spark, json.dumps(GOOD | {"verdict": "correct", "confidence": 1}))
    assert (b["first_error_step"], b["error_type"], b["reported_error"]) == (None, None, False)
    assert _audit(spark, json.dumps(GOOD | {"error_type": "weird"}))["error_type"] is None


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("3 + 4 = 7.", [(7.0, 7.0, True)]), ("10 + 7 + 6 = 23", [(23.0, 23.0, True)]), ("2 + 3 * 4 = 14", [(14.0, 14.0, True)]), ("100 - 20 - 30 = 50", [(50.0, 50.0, True)]),
        (r"6 \times 7 = 41", [(42.0, 41.0, False)]), ("1,200 / 4 = 300", [(300.0, 300.0, True)]), ("5 / 0 = 1", [(None, 1.0, True)]), ("x + 1 = 2", []), ("1 / 3 = 0.333", [(1 / 3, 0.333, True)]),
        ("b_1 + 2 = 3", []), ("we say nothing", []), ("10 - 6 / 3 * 2 = 6 and 2 + 2 = 5", [(6.0, 6.0, True), (4.0, 5.0, False)]),
    ],
)
def test_claims(spark, text, values):
    x = spark.createDataFrame([(text,)], "t string").select(F.explode(claims.claims(F.col("t"))).alias("c"))
    got = x.select(claims.claim_value(F.col("c")), F.col("c.result"), claims.claim_holds(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(pytest.approx(v) if v is not None else None, r, h) for v, r, h in values]


@pytest.mark.parametrize(("text", "answer"), [(r"so \boxed{1,200}", "1200"), ("The answer is 3.50", "3.5"), ("it leaves 4 and 9", "9"), ("none", None), (r"\boxed{2} total 7", "2"), ("result: -3", "-3")])
def test_final_answers(spark, text, answer):
    assert spark.createDataFrame([(text,)], "t string").select(claims.final_answer(F.col("t"))).first()[0] == answer


def _validate(spark, original, injected, k):
    x = spark.createDataFrame([(1, original, injected, k)], "id int, steps array<string>, injected array<string>, k int").withColumn("answer", F.element_at("steps", -1))
    return postings.checked(x, ["id"]).select(F.transform("reasons", faults.reason_class)).first()[0]


ORIGINAL = ["Start.", "2 + 3 = 5", "5 + 1 = 6", "The answer is 6"]


def test_validation(spark):
    assert _validate(spark, ORIGINAL, ["Start.", "2 + 3 = 7", "7 + 1 = 8", "The answer is 8"], 2) == []
    assert _validate(spark, ORIGINAL, ORIGINAL[:3], 2) == ["step count"]
    assert "unchanged" in _validate(spark, ORIGINAL, ORIGINAL, 2)
    assert "prefix" in _validate(spark, ORIGINAL, ["Begin.", "2 + 3 = 7", "7 + 1 = 8", "The answer is 8"], 2)
    assert "not propagated" in _validate(spark, ORIGINAL, ["Start.", "2 + 3 = 7", "5 + 1 = 6", "The answer is 8"], 2)
    assert "inconsistent arithmetic" in _validate(spark, ORIGINAL, ["Start.", "2 + 5 = 7", "7 + 1 = 9", "The answer is 8"], 2)
    # Only the first false claim from the fault step on counts, and the fault step's own is no reason.
    assert "inconsistent arithmetic" not in _validate(spark, ORIGINAL, ["Start.", "2 + 3 = 7", "7 + 1 = 9", "The answer is 8"], 2)
    assert "control character" in _validate(spark, ORIGINAL, ["Start.", "2 +\t3 = 7", "7 + 1 = 8", "The answer is 8"], 2)
    assert "echoed step prefix" in _validate(spark, ORIGINAL, ["Start.", "Step 2: 2 + 3 = 7", "7 + 1 = 8", "The answer is 8"], 2)
    assert "shorter" in _validate(spark, ORIGINAL, ["Start.", "7", "7 + 1 = 8", "The answer is 8"], 2)
    assert _validate(spark, ORIGINAL, ["Start.", "2 + 3 = 7", "7 - 1 = 6", "The answer is 6"], 2) == ["final answer"]
    with pytest.raises(Exception, match="outside the trace"):
        _validate(spark, ORIGINAL, ORIGINAL, 5)


def test_reasons_of_many_traces_at_once(spark):
    """Every stale value of every step, in order; traces keep to themselves."""
    rows = [
        (1, ["a", "2 + 3 = 5", "5 + 2 = 7", "so 5 and 3 is 7"], ["a", "4 + 4 = 8", "5 + 2 = 7", "so 5 and 3 is 9"], 2),
        (2, ["a", "2 + 3 = 5", "5 + 1 = 6"], ["a", "2 + 4 = 6", "6 + 1 = 7"], 2),
        (3, ["a", "b"], ["a"], 1),
    ]
    x = spark.createDataFrame(rows, "id int, steps array<string>, injected array<string>, k int").withColumn("answer", F.element_at("steps", -1)).repartition(3)
    got = {r["id"]: r["reasons"] for r in postings.checked(x, ["id"]).collect()}
    stale = lambda step, value: f"step {step} still uses {value}: the fault was not propagated"
    assert got == {1: [stale(3, 2.0), stale(3, 5.0), stale(4, 3.0), stale(4, 5.0)], 2: [], 3: ["step count 1 != 2"]}


@pytest.mark.parametrize(
    ("text", "original", "expected"),
    [("**Step 7:** so *x* is _y_", "plain", "so x is y"), ("a  b\nc", "one line", "a b c"), ("a\nb", "two\nlines", "a\nb"), ("**b** x_1", "uses **bold**", "**b** x_1"), ("From Step 3 we know", "o", "From Step 3 we know")],
)
def test_normalised_steps(spark, text, original, expected):
    assert spark.createDataFrame([(text, original)], "t string, o string").select(faults.normalise_step(F.col("t"), F.col("o"))).first()[0] == expected


def test_suffixes(spark):
    parse = lambda raw, n: spark.createDataFrame([(raw, n)], "r string, n int").select(faults.parse_suffix(F.col("r"), F.col("n"))).first()[0]
    assert parse(f" a \n{faults.SENTINEL}\n b", 2) == ["a", "b"]
    assert parse("a", 2) is None and parse(f"a{faults.SENTINEL} ", 2) is None


def test_only_the_sentence_varies(spark):
    x = spark.createDataFrame([("p {slot}", ["a", "b"])], "p string, s array<string>")
    text = {(c, w): x.select(prompts.audit_request(F.col("p"), F.col("s"), F.lit(c), F.lit(w))).first()[0] for c in ("R0", "R2") for w in ("F1", "F5")}
    for w in ("F1", "F5"):
        assert text["R2", w].replace(prompts.CONDITIONS["R2"] + " ", "") == text["R0", w]
    assert "p {slot}" in text["R0", "F1"] and "Step 1: a\nStep 2: b" in text["R0", "F1"]
    assert x.select(prompts.audit_request(F.col("p"), F.col("s"), F.lit("R9"), F.lit("F1"))).first()[0] is None


def test_cells_end_with_the_same_request(spark):
    x = spark.range(1)
    ends = []
    for cell in ("AS", "AO", "US", "UO", "AV", "AN", "AF", "AX", "AXN"):
        m = x.select(prompts.episode_messages(F.lit(cell), F.lit("T"), F.lit("q"), F.lit("a"), F.lit("r"), F.lit("n"), F.lit("fq"), F.lit("f")).alias("m")).first()["m"]
        ends.append(m[-1]["content"])
        assert m[0]["role"] == "system" and m[-1]["role"] == "user"
        assert any(t["role"] == "assistant" for t in m) == (cell not in ("US", "UO"))
    assert len(set(ends)) == 1
