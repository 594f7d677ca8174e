"""Parsing, prompt, claim and fault-validation queries over generated traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictspark.functions import audits, claims, faults, prompts
from verdictspark.functions.stats import rounded
from verdictspark.operators import postings
from verdictspark.plans.rates import _with
from verdictspark.plans.design import usable_episodes
from verdictspark.sources.fixtures import view

#: Malformed verdicts: no JSON, a list, an unknown verdict, a confidence out of range or missing, evidence that is no string, text behind the object.
MALFORMED = (
    "not json", "[1, 2]", '{"verdict": "maybe", "confidence": 0.5, "evidence": "x"}', '{"verdict": "correct", "confidence": 1.5, "evidence": "x"}',
    '{"verdict": "correct", "confidence": null, "evidence": "x"}', '{"verdict": "correct", "confidence": 0.5, "evidence": 42}', '{"verdict": "correct", "confidence": 0.5, "evidence": "x"} trailing',
)
N_STEPS = 4


def raw_audits(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts as JSON text, unparsable where the fixture says so."""
    v = view(spark, sf, "ladder_verdicts")
    good = F.concat(
        F.lit('{"verdict": "'), F.when(F.col("flag") == 1, "incorrect").otherwise("correct"), F.lit('", "first_error_step": '), F.coalesce(F.col("step").cast("string"), F.lit("null")),
        F.lit(', "confidence": '), F.col("confidence").cast("string"), F.lit(', "error_type": '), F.when(F.col("flag") == 1, '"arithmetic"').otherwise("null"), F.lit(', "evidence": "so {it} goes"}'),
    )
    bad = F.element_at(F.array(*[F.lit(m) for m in MALFORMED]), (F.col("item_id") % len(MALFORMED) + 1).cast("int"))
    return v.select("auditor", "condition", "item_id", "sample", F.when(F.col("parsed"), good).otherwise(bad).alias("raw"))


def parse_audit(spark: SparkSession, sf: str) -> DataFrame:
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", True)
    raw = raw_audits(spark, sf).withColumn("audit", audits.parse_audit(F.col("raw"), F.lit(N_STEPS)))
    a = F.col("audit")
    return raw.select("auditor", "condition", "item_id", "sample", a.isNotNull().alias("parsed"), a["verdict"].alias("verdict"), F.coalesce(a["first_error_step"], F.lit(0)).alias("first_error_step"), rounded(a["confidence"]).alias("confidence"), a["error_type"].alias("error_type"), F.coalesce(a["localization_usable"], F.lit(False)).alias("localization_usable"))


def audit_records(spark: SparkSession, sf: str) -> DataFrame:
    """Ragged samples of each item exploded to long rows; failures stay as parsed = false."""
    raw = raw_audits(spark, sf).groupBy("auditor", "condition", "item_id").agg(F.array_sort(F.collect_list(F.struct("sample", "raw"))).alias("rows"))
    long = raw.select("auditor", "condition", "item_id", F.posexplode_outer("rows").alias("sample", "r")).withColumn("audit", audits.parse_audit(F.col("r.raw"), F.lit(N_STEPS)))
    out = long.groupBy("auditor", "condition").agg(F.count(F.lit(1)).alias("rows"), F.count("audit").alias("parsed"), F.count_if(F.col("audit.reported_error")).alias("reported"), F.max("sample").cast("long").alias("last_sample"))
    return out


def step_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each trace: its steps in order."""
    rows = view(spark, sf, "trace_text").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("step_no", "step_text"))).alias("rows"))
    return rows.select("item_id", F.transform("rows", lambda r: r["step_text"]).alias("steps"))


def audit_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The user turn of every trace under one condition and wording (dealt by id)."""
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("item_id") % len(names) + 1).cast("int"))
    x = step_arrays(spark, sf).withColumn("condition", pick(list(prompts.CONDITIONS))).withColumn("wording", pick(list(prompts.WORDINGS)))
    text = prompts.audit_request(F.concat(F.lit("Problem {steps} "), F.col("item_id").cast("string")), F.col("steps"), F.col("condition"), F.col("wording"))
    return x.select("item_id", "condition", "wording", F.length(text).cast("long").alias("chars"), F.md5(text.cast("binary")).alias("digest"))


CELLS = ("AS", "AO", "US", "UO", "AV", "AN", "AXN", "AX", "AF")


def r4_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Every trace behind an episode under one cell (dealt by id): roles and a digest of all turns."""
    pool = usable_episodes(spark, sf).select("pos", "request", "audit", "repair")
    cell = F.element_at(F.array(*[F.lit(c) for c in CELLS]), (F.col("item_id") % len(CELLS) + 1).cast("int"))
    x = step_arrays(spark, sf).withColumn("cell", cell).join(F.broadcast(pool), F.col("item_id") % 10 == F.col("pos"))
    target = prompts.audit_request(F.concat(F.lit("Problem "), F.col("item_id").cast("string")), F.col("steps"), F.lit("R0"), F.lit("F1"))
    request = F.coalesce("request", F.lit(""))
    turns = prompts.episode_messages(F.col("cell"), target, request, F.col("audit"), F.col("repair"), F.lit("restated"), F.lit("filler?"), F.lit("filler."))
    text = F.array_join(F.transform(turns, lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|")
    return x.select("item_id", "cell", F.size(turns).cast("long").alias("n_messages"), F.array_join(F.transform(turns, lambda m: m["role"]), ",").alias("roles"), F.md5(text.cast("binary")).alias("digest"))


def arithmetic_claims(spark: SparkSession, sf: str) -> DataFrame:
    x = view(spark, sf, "trace_text").select("item_id", "step_no", F.explode(claims.claims(F.col("step_text"))).alias("c"))
    return x.select("item_id", "step_no", rounded(claims.claim_value(F.col("c"))).alias("value"), rounded(F.col("c.result")).alias("result"), claims.claim_holds(F.col("c")).alias("holds"))


def injectable_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Steps that can carry a fault: the first, middle and last one (0: none), and whether the trace is a source."""
    x = step_arrays(spark, sf).withColumn("at", faults.injectable_steps(F.col("steps"))).withColumn("eligible", faults.is_eligible(F.col("steps")))
    pick = lambda e: F.when(F.size("at") > 0, e).otherwise(0).cast("long")
    spread = (F.size("at") >= 2) & (F.array_max("at") - F.array_min("at") >= 2)
    return x.select(
        "item_id", F.size("at").cast("long").alias("n_injectable"), pick(F.array_min("at")).alias("early"), pick(F.try_element_at("at", F.expr("cast(size(at) div 2 + 1 as int)"))).alias("middle"),
        pick(F.array_max("at")).alias("late"), F.coalesce(spread, F.lit(False)).alias("position_eligible"), "eligible",
    )


def final_answer(spark: SparkSession, sf: str) -> DataFrame:
    x = view(spark, sf, "trace_text")
    kind = F.col("item_id") % 3
    text = F.when(kind == 0, F.concat(F.lit("Thus 5, so \\boxed{ "), F.col("r").cast("string"), F.lit(" }."))).when(kind == 1, F.concat(F.lit("9 left. The Answer is "), F.col("r").cast("string"), F.lit(".0 now"))).otherwise(F.col("step_text"))
    return x.select("item_id", "step_no", claims.final_answer(text).alias("answer"))


def injections(spark: SparkSession, sf: str) -> DataFrame:
    """Traces with a fault step k (the first claim from step 2 on) and an injected variant by id.

    0 drops the last step, 1 changes nothing, 2 changes the first step and k's result,
    3 guts step k.
    """
    x = step_arrays(spark, sf).withColumn("k", F.try_element_at(faults.injectable_steps(F.col("steps")), F.lit(1))).where("k is not null")
    rows = view(spark, sf, "trace_text").select("item_id", F.col("step_no").cast("int").alias("k"), "a", "b", "r")
    x = x.join(rows, ["item_id", "k"]).withColumn("variant", F.col("item_id") % 4)
    fault = F.concat(F.lit("We add items: "), F.col("a").cast("string"), F.lit(" + "), F.col("b").cast("string"), F.lit(" = "), (F.col("r") + 1).cast("string"), F.lit("."))
    changed = F.transform("steps", lambda s, i: F.when(i == 0, F.concat(s, F.lit(" x"))).when(i + 1 == F.col("k"), fault).otherwise(s))
    gutted = F.transform("steps", lambda s, i: F.when(i + 1 == F.col("k"), F.lit("z")).otherwise(s))
    injected = F.when(F.col("variant") == 0, F.slice("steps", F.lit(1), F.size("steps") - 1)).when(F.col("variant") == 1, F.col("steps")).when(F.col("variant") == 2, changed).otherwise(gutted)
    return x.select("item_id", "variant", "k", "steps", injected.alias("injected"))


def unpropagated_values(spark: SparkSession, sf: str) -> DataFrame:
    x = injections(spark, sf).where("variant = 2").select("item_id", F.explode(faults.stale_values(F.col("steps"), F.col("injected"), F.col("k"))).alias("s"))
    return x.select("item_id", F.col("s.step").cast("long").alias("step"), F.explode("s.values").alias("value"))


def _validated(spark: SparkSession, sf: str) -> DataFrame:
    return postings.checked(injections(spark, sf).withColumn("answer", F.element_at("steps", -1)), ["item_id", "variant"])


def validate_injection(spark: SparkSession, sf: str) -> DataFrame:
    classes = F.array_sort(F.array_distinct(F.transform("reasons", faults.reason_class)))
    return _validated(spark, sf).select("item_id", "variant", (F.size("reasons") == 0).alias("ok"), F.array_join(classes, ",").alias("classes"))


def rejection_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """Traces rejected for each class."""
    x = _validated(spark, sf).select("item_id", F.explode(F.array_distinct(F.transform("reasons", faults.reason_class))).alias("reason"))
    return x.groupBy("reason").agg(F.count(F.lit(1)).alias("traces"))


def normalise_splice(spark: SparkSession, sf: str) -> DataFrame:
    """Suffixes with echoed numbers, emphasis and spaces come back as the original's text."""
    x = step_arrays(spark, sf).where(F.size("steps") >= 2).withColumn("k", (F.col("item_id") % (F.size("steps") - 1) + 2).cast("int"))
    tail = F.slice("steps", F.col("k"), F.size("steps") - F.col("k") + 1)
    marked = F.transform(tail, lambda s, i: F.concat(F.lit("  **Step "), (i + F.col("k")).cast("string"), F.lit(":** "), F.regexp_replace(F.regexp_replace(s, "^We ", "_We_  "), "items", "*items*")))
    raw = F.array_join(marked, "\n" + faults.SENTINEL + "\n")
    done = faults.splice(F.col("steps"), F.col("k"), faults.parse_suffix(raw, F.size(tail)))
    return x.select("item_id", F.size(done).cast("long").alias("n_steps"), F.md5(F.array_join(done, "|").cast("binary")).alias("digest"))


def prompt_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every trace under every condition and wording: prompts and their characters."""
    grid = spark.createDataFrame([(c, w) for c in prompts.CONDITIONS for w in prompts.WORDINGS], "condition string, wording string")
    x = step_arrays(spark, sf).crossJoin(F.broadcast(grid))
    text = prompts.audit_request(F.concat(F.lit("Problem "), F.col("item_id").cast("string")), F.col("steps"), F.col("condition"), F.col("wording"))
    return x.select("condition", "wording", F.length(text).alias("n")).groupBy("condition", "wording").agg(F.count(F.lit(1)).alias("prompts"), F.sum("n").cast("long").alias("chars"))


def revalidation_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Stored faults under the present checks: kept, never accepted (variant 0), or dropped with the classes against them."""
    x = validate_injection(spark, sf)
    outcome = F.when(F.col("variant") == 0, "not accepted originally").when(F.col("ok"), "kept").otherwise(F.concat(F.lit("revalidate: "), "classes"))
    return x.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("traces"))


def word_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Words that a filler of each episode's length should have."""
    e = view(spark, sf, "episodes")
    chars = F.length(F.coalesce("audit", F.lit(""))) + F.length(F.coalesce("repair", F.lit("")))
    return e.select("item_id", prompts.word_target(chars).alias("words"))


QUERIES = {
    f.__name__: f
    for f in (
        parse_audit, audit_records, audit_prompts, r4_prompts, arithmetic_claims, injectable_steps, final_answer, unpropagated_values, validate_injection, rejection_breakdown,
        normalise_splice, prompt_grid, revalidation_counts, word_targets,
    )
}


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(key: str, options: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {_text(v)}" for k, v in options.items()) + " END"


def _listed(names: tuple[str, ...] | list[str], n: str) -> str:
    return f"([{', '.join(_text(x) for x in names)}])[({n}) % {len(names)} + 1]"


STEPS = "st AS (SELECT item_id, string_agg(concat('Step ', step_no, ': ', step_text), chr(10) ORDER BY step_no) AS numbered FROM trace_text GROUP BY item_id)"
_first = "concat('[author: self] ', audit)"
_peer = "concat('[author: peer] ', audit)"


def _cells() -> str:
    sys_, last = f"concat('system=', {_text(prompts.SYSTEM)})", f"concat('user=', {_text(prompts.HANDOFF)}, chr(10), chr(10), target)"
    fix, say = _text("user=" + prompts.REPAIR_REQUEST), _text("user=" + prompts.NEUTRAL_REQUEST)
    a = lambda who: f"concat('assistant=[author: {who}] ', audit)"
    r = lambda who: f"concat('assistant=[author: {who}] ', repair)"
    ask, neutral = "concat('user=', request)", "'assistant=[author: self] restated'"
    quoted = lambda who: f"concat_ws(chr(10) || chr(10), 'user=' || request, '[author: {who}] ' || audit, {_text(prompts.REPAIR_REQUEST)}, '[author: {who}] ' || repair)"
    bodies = {
        "AS": [ask, a("self"), fix, r("self")], "AX": [ask, a("self"), fix, r("self")], "AO": [ask, a("peer"), fix, r("peer")], "US": [quoted("self")], "UO": [quoted("peer")],
        "AV": [ask, a("self")], "AN": [ask, a("self"), say, neutral], "AXN": [ask, a("self"), say, neutral], "AF": ["'user=filler?'", "'assistant=filler.'"],
    }
    return "CASE cell " + " ".join(f"WHEN '{c}' THEN [{', '.join([sys_, *b, last])}]" for c, b in bodies.items()) + " END"


TT = "trace_text"
FAULT = (
    "kk AS (SELECT item_id, min(step_no) AS k, item_id % 4 AS variant FROM trace_text WHERE has_claim AND step_no >= 2 GROUP BY item_id), "
    "nn AS (SELECT item_id, max(step_no) AS n FROM trace_text GROUP BY item_id), "
    "fk AS (SELECT kk.item_id, k, variant, n, t.a, t.b, t.r FROM kk JOIN nn USING (item_id) JOIN trace_text t ON t.item_id = kk.item_id AND t.step_no = k)"
)
REASONS = (
    f"{FAULT}, lt AS (SELECT f.item_id, bool_or(t.step_no > k AND t.has_claim AND t.a + t.b <> t.r) AS later_bad, bool_or(t.step_no = n AND t.has_claim) AS ends_claim, "
    "bool_or(t.step_no > k AND t.has_claim AND ((variant = 2 AND r0 NOT IN (a0, b0) AND r0 IN (t.a, t.b, t.r)) OR (variant = 3 AND (r0 IN (t.a, t.b, t.r) OR a0 IN (t.a, t.b, t.r) OR b0 IN (t.a, t.b, t.r))))) AS stale "
    "FROM (SELECT item_id, k, variant, n, a AS a0, b AS b0, r AS r0 FROM fk) f JOIN trace_text t USING (item_id) GROUP BY f.item_id), "
    "rs AS (SELECT item_id, variant, unnest(CASE WHEN variant = 0 THEN ['step count'] ELSE list_filter(["
    "CASE WHEN variant = 2 THEN 'prefix' END, CASE WHEN variant = 1 THEN 'unchanged' END, CASE WHEN variant = 3 THEN 'shorter' END, CASE WHEN variant IN (2, 3) AND stale THEN 'not propagated' END, "
    "CASE WHEN later_bad AND (variant = 3 OR (variant = 1 AND a + b = r)) THEN 'inconsistent arithmetic' WHEN variant = 2 AND later_bad AND a + b = r + 1 THEN 'inconsistent arithmetic' END, "
    "CASE WHEN NOT ends_claim OR variant = 1 OR k < n OR variant = 3 THEN 'final answer' END], lambda x: x IS NOT NULL) END) AS reason FROM fk JOIN lt USING (item_id))"
)
ORACLES = {
    "parse_audit": _with(f"SELECT auditor, condition, item_id, sample, parsed, CASE WHEN parsed THEN CASE WHEN flag = 1 THEN 'incorrect' ELSE 'correct' END END AS verdict, CASE WHEN parsed AND step <= {N_STEPS} THEN step ELSE 0 END AS first_error_step, CASE WHEN parsed THEN round(confidence, 6) + 0.0 END AS confidence, CASE WHEN parsed AND flag = 1 THEN 'arithmetic' END AS error_type, parsed AND coalesce(step <= {N_STEPS}, false) AS localization_usable FROM ladder_verdicts", "ladder_verdicts"),
    "audit_records": _with("SELECT auditor, condition, count(*) AS rows, count(*) FILTER (parsed) AS parsed, count(*) FILTER (parsed AND flag = 1) AS reported, max(sample) AS last_sample FROM ladder_verdicts GROUP BY ALL", "ladder_verdicts"),
    "audit_prompts": _with(
        f"{STEPS}, pk AS (SELECT *, {_listed(list(prompts.CONDITIONS), 'item_id')} AS condition, {_listed(list(prompts.WORDINGS), 'item_id')} AS wording FROM st), "
        f"tx AS (SELECT item_id, condition, wording, concat({', '.join([_case('wording', {w: p[0] for w, p in prompts.WORDINGS.items()}), _text('Problem {steps} '), 'item_id', _case('wording', {w: p[1] for w, p in prompts.WORDINGS.items()}), 'numbered', _case('wording', {w: p[2] for w, p in prompts.WORDINGS.items()}), _case('condition', {c: s + ' ' if s else '' for c, s in prompts.CONDITIONS.items()}), _case('wording', {w: p[3] for w, p in prompts.WORDINGS.items()})])}) AS t FROM pk) "
        "SELECT item_id, condition, wording, length(t) AS chars, md5(t) AS digest FROM tx", TT),
    "r4_prompts": _with(
        f"{STEPS}, ok AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, coalesce(request, '') AS request, audit, repair FROM episodes WHERE audit IS NOT NULL AND repair IS NOT NULL ORDER BY pos LIMIT 10), "
        f"pk AS (SELECT item_id, {_listed(CELLS, 'item_id')} AS cell, request, audit, repair, concat({_text(prompts.WORDINGS['F1'][0])}, 'Problem ', item_id, {_text(prompts.WORDINGS['F1'][1])}, numbered, {_text(prompts.WORDINGS['F1'][2])}, {_text(prompts.WORDINGS['F1'][3])}) AS target FROM st JOIN ok ON item_id % 10 = pos), "
        f"ms AS (SELECT item_id, cell, {_cells()} AS m FROM pk) SELECT item_id, cell, len(m) AS n_messages, array_to_string(list_transform(m, lambda x: split_part(x, '=', 1)), ',') AS roles, md5(array_to_string(m, '|')) AS digest FROM ms", TT, "episodes"),
    "arithmetic_claims": _with("SELECT item_id, step_no, (a + b)::DOUBLE AS value, r::DOUBLE AS result, abs(a + b - r) <= greatest(0.005 * greatest(abs(a + b), abs(r)), 0.005) AS holds FROM trace_text WHERE has_claim", TT),
    "injectable_steps": _with(
        "j AS (SELECT item_id, count(*) FILTER (has_claim AND step_no >= 2) AS n_injectable, list_sort(list(step_no) FILTER (has_claim AND step_no >= 2)) AS l, count(*) AS n, bool_or(has_claim AND a + b <> r) AS bad FROM trace_text GROUP BY item_id) "
        "SELECT item_id, n_injectable, coalesce(l[1], 0) AS early, coalesce(l[len(l) // 2 + 1], 0) AS middle, coalesce(l[-1], 0) AS late, coalesce(n_injectable >= 2 AND l[-1] - l[1] >= 2, false) AS position_eligible, n >= 4 AND n_injectable > 0 AND NOT coalesce(bad, false) AS eligible FROM j", TT),
    "final_answer": _with("SELECT item_id, step_no, CASE WHEN item_id % 3 < 2 OR has_claim THEN r::VARCHAR END AS answer FROM trace_text", TT),
    "unpropagated_values": _with(f"{FAULT} SELECT f.item_id, t.step_no AS step, f.r::DOUBLE AS value FROM fk f JOIN trace_text t ON t.item_id = f.item_id AND t.step_no > f.k AND t.has_claim WHERE variant = 2 AND f.r NOT IN (f.a, f.b) AND f.r IN (t.a, t.b, t.r)", TT),
    "validate_injection": _with(f"{REASONS}, cl AS (SELECT item_id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS classes FROM rs GROUP BY item_id) SELECT item_id, variant, classes IS NULL AS ok, coalesce(classes, '') AS classes FROM fk LEFT JOIN cl USING (item_id)", TT),
    "rejection_breakdown": _with(f"{REASONS} SELECT reason, count(DISTINCT item_id) AS traces FROM rs GROUP BY reason", TT),
    "normalise_splice": _with("g AS (SELECT item_id, count(*) AS n_steps, string_agg(step_text, '|' ORDER BY step_no) AS t FROM trace_text GROUP BY item_id) SELECT item_id, n_steps, md5(t) AS digest FROM g WHERE n_steps >= 2", TT),
    "word_targets": _with("SELECT item_id, greatest(30, round_even((length(coalesce(audit, '')) + length(coalesce(repair, ''))) / 5.5::DOUBLE, 0))::BIGINT AS words FROM episodes", "episodes"),
}
_parts = lambda k: _case("wording", {w: p[k] for w, p in prompts.WORDINGS.items()})
_slot = _case("condition", {c: s + " " if s else "" for c, s in prompts.CONDITIONS.items()})
ORACLES["prompt_grid"] = _with(
    f"{STEPS}, gr AS (SELECT item_id, numbered, c.condition, w.wording FROM st, (VALUES {', '.join(f'({_text(c)})' for c in prompts.CONDITIONS)}) c(condition), (VALUES {', '.join(f'({_text(w)})' for w in prompts.WORDINGS)}) w(wording)) "
    f"SELECT condition, wording, count(*) AS prompts, sum(length(concat({_parts(0)}, 'Problem ', item_id, {_parts(1)}, numbered, {_parts(2)}, {_slot}, {_parts(3)})))::BIGINT AS chars FROM gr GROUP BY ALL", TT)
ORACLES["revalidation_counts"] = f"WITH v AS ({ORACLES['validate_injection']}) SELECT CASE WHEN variant = 0 THEN 'not accepted originally' WHEN ok THEN 'kept' ELSE concat('revalidate: ', classes) END AS outcome, count(*) AS traces FROM v GROUP BY ALL"
