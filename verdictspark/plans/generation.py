"""The generation side over recorded answers: episodes, fillers, promises, greedy passes, fault attempts.

A served model is outside the engine: sources.models.generate asks one, or replays what was
recorded. What is done with the answers is relational and runs here over recorded ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictspark.functions import audits, faults, prompts
from verdictspark.functions.stats import rounded
from verdictspark.operators import generation, rates
from verdictspark.plans.rates import CELL, R, _with
from verdictspark.plans.text import FAULT, N_STEPS, TT, _text, raw_audits, step_arrays
from verdictspark.sources.fixtures import view

PROMISED = {"R1": "delegated", "R2": "separate-request", "R3": "same-context"}
PAIR_YIELD = 0.83


def injection_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """The request for a fault at a step from 2 on, under a family dealt by id."""
    x = step_arrays(spark, sf).where(F.size("steps") >= 2).withColumn("k", (F.col("item_id") % (F.size("steps") - 1) + 2).cast("int"))
    x = x.withColumn("family", F.when(F.col("item_id") % 2 == 0, "local").otherwise("structural"))
    turns = prompts.injection_messages(F.col("steps"), F.col("k"), F.col("family"))
    user = F.element_at(turns, 2)["content"]
    return x.select("item_id", F.col("k").cast("long").alias("k"), "family", F.length(user).cast("long").alias("chars"), F.md5(user.cast("binary")).alias("digest"))


def fault_attempts(spark: SparkSession, sf: str, families: int = 1) -> DataFrame:
    """Recorded attempts at the first injectable step: by id and attempt no answer, a suffix of another length, or k's result plus one."""
    x = step_arrays(spark, sf).withColumn("k", F.try_element_at(faults.injectable_steps(F.col("steps")), F.lit(1))).where("k is not null")
    own = view(spark, sf, "trace_text").select("item_id", F.col("step_no").cast("int").alias("k"), "a", "b", "r")
    x = x.join(own, ["item_id", "k"]).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("family", F.explode(F.sequence(F.lit(0), F.lit(families - 1))))
    tail = F.slice("steps", F.col("k") + 1, F.size("steps"))
    fault = F.concat(F.lit("We add items: "), F.col("a").cast("string"), F.lit(" + "), F.col("b").cast("string"), F.lit(" = "), (F.col("r") + 1).cast("string"), F.lit("."))
    joined = lambda parts: F.array_join(parts, "\n" + faults.SENTINEL + "\n")
    kind = (F.col("item_id") + F.col("attempt") + F.col("family")) % 3
    raw = F.when(kind == 0, F.lit(None)).when(kind == 1, joined(F.concat(F.array(fault), tail, F.array(F.lit("more"))))).otherwise(joined(F.concat(F.array(fault), tail)))
    return x.select("item_id", "family", "attempt", "steps", "k", raw.alias("raw"))


def accepted_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """The first accepted attempt of each trace (0: none) and the classes of what was rejected before it."""
    found = generation.first_accepted(fault_attempts(spark, sf), ["item_id"])
    classes = F.array_sort(F.array_distinct(F.transform("reasons", faults.reason_class)))
    return found.select("item_id", "accepted", F.coalesce("attempt", F.lit(0)).cast("long").alias("attempt"), "tried", F.array_join(classes, ",").alias("classes"))


def fault_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Traces tried under both families: only those with a fault accepted under each make a pair."""
    found = generation.first_accepted(fault_attempts(spark, sf, 2), ["item_id", "family"])
    pairs = generation.complete_pairs(found, ["item_id"], 2)
    return pairs.select("item_id", "complete", "accepted")


def yield_table(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted under each family and under both, against the yield that a run needs."""
    found = generation.first_accepted(fault_attempts(spark, sf, 2), ["item_id", "family"])
    by = found.groupBy("item_id").agg(*[F.bool_or(F.col("accepted") & (F.col("family") == k)).alias(n) for k, n in enumerate(("local", "structural"))])
    out = by.agg(F.count(F.lit(1)).alias("sources"), F.count_if("local").alias("local_accepted"), F.count_if("structural").alias("structural_accepted"), F.count_if(F.col("local") & F.col("structural")).alias("both_accepted"))
    rate = F.try_divide("both_accepted", "sources")
    return out.select("*", rounded(rate).alias("pair_rate"), F.when(rate >= PAIR_YIELD, "MET").otherwise("NOT MET").alias("target"))


def position_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Early and late faults of a trace (k's result plus one at its first and last injectable step): kept where both are accepted."""
    x = step_arrays(spark, sf).withColumn("at", faults.injectable_steps(F.col("steps"))).where(F.size("at") >= 2)
    x = x.withColumn("family", F.explode(F.array(F.lit("early"), F.lit("late")))).withColumn("k", F.when(F.col("family") == "early", F.array_min("at")).otherwise(F.array_max("at")))
    own = view(spark, sf, "trace_text").select("item_id", F.col("step_no").cast("int").alias("k"), "a", "b", "r")
    fault = F.concat(F.lit("We add items: "), F.col("a").cast("string"), F.lit(" + "), F.col("b").cast("string"), F.lit(" = "), (F.col("r") + 1).cast("string"), F.lit("."))
    raw = F.array_join(F.concat(F.array(fault), F.slice("steps", F.col("k") + 1, F.size("steps"))), "\n" + faults.SENTINEL + "\n")
    tries = x.join(own, ["item_id", "k"]).select("item_id", "family", F.lit(1).alias("attempt"), "steps", "k", raw.alias("raw"))
    found = generation.first_accepted(tries, ["item_id", "family"])
    return generation.complete_pairs(found, ["item_id"], 2).select("item_id", "complete", "accepted")


def recorded_episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes as recorded: the audit as JSON (by position missing or malformed) and the repair."""
    good = F.concat(F.lit('{"verdict": "'), F.when(F.col("pos") % 3 == 0, "incorrect").otherwise("correct"), F.lit('", "confidence": 0.5, "first_error_step": 1, "evidence": "e'), F.col("pos").cast("string"), F.lit('"}'))
    raw = F.when(F.col("pos") % 7 == 0, F.lit(None)).when(F.col("pos") % 5 == 0, F.concat(good, F.lit(" and more"))).otherwise(F.concat(F.lit("  "), good, F.lit("\n")))
    return view(spark, sf, "episodes").select("pos", "item_id", "request", raw.alias("audit_raw"), F.col("repair").alias("repair_raw"))


def episode_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Usable episodes in order: a parsed audit and a repair; others are left out."""
    pool = generation.episodes(recorded_episodes(spark, sf), F.lit(N_STEPS))
    return pool.select("pos", "item_id", "reported_error", F.length("audit").cast("long").alias("audit_chars"), F.length("repair").cast("long").alias("repair_chars"))


def incorrect_pool(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 episodes that report an error, and whether every audit of the pool says so."""
    pool = generation.require_all_incorrect(generation.episodes(recorded_episodes(spark, sf), F.lit(N_STEPS)).where("reported_error").orderBy("pos").limit(20))
    return pool.agg(F.count(F.lit(1)).alias("episodes"), F.count_if(~F.col("audit").contains('"incorrect"')).alias("violations"), F.coalesce(F.max("pos"), F.lit(-1)).cast("long").alias("last_pos"))


def filler_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests for fillers of the length of each usable episode, and for restatements of the length of its repair."""
    pool = generation.episodes(recorded_episodes(spark, sf), F.lit(N_STEPS))
    filler = prompts.filler_request(F.coalesce("request", F.lit("")), F.length("audit") + F.length("repair"))
    neutral = prompts.neutral_request(F.length("repair"))
    return pool.select("item_id", F.length(filler).cast("long").alias("filler_chars"), F.md5(filler.cast("binary")).alias("filler_digest"), neutral.alias("neutral"))


def episode_items(spark: SparkSession, sf: str) -> DataFrame:
    """The trace behind each episode: its inline steps (every fourth has some) before the lookup's; without either it is refused."""
    pool = view(spark, sf, "episodes").select("pos", (F.col("pos") * 3 + 1).alias("trace"), F.when(F.col("pos") % 4 == 0, F.array(F.lit("inline"), F.lit("steps"))).alias("inline"))
    out = generation.items_behind(pool, step_arrays(spark, sf).select(F.col("item_id").alias("trace"), "steps"), "trace")
    return out.select("pos", F.coalesce(F.size("steps"), F.lit(0)).cast("long").alias("n_steps"), "source")


def kept_promises(spark: SparkSession, sf: str) -> DataFrame:
    """For the first sample of each item, whether the repair that its condition announced came; R1's is another's job.

    Recorded repairs are the later answers of the conversations, by id: an item may have none.
    """
    first = raw_audits(spark, sf).where("sample = 0").join(F.broadcast(spark.createDataFrame(list(PROMISED.items()), "condition string, mode string")), "condition")
    repairs = view(spark, sf, "episodes").select(F.col("pos").alias("item_id"), generation.stripped(F.col("repair")).alias("repair"))
    keys = ["auditor", "condition", "item_id"]
    due = first.where("mode <> 'delegated'").select(*keys, F.col("raw").alias("audit"))
    due = generation.promises(due, due.select(*keys).join(repairs, "item_id"), keys)
    return first.join(due, keys, "left").groupBy("auditor", "condition", "mode").agg(F.count(F.lit(1)).alias("items"), F.count_if("performed").alias("n_performed"))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded answers parsed: parsed and flag of each sample."""
    a = audits.parse_audit(F.col("raw"), F.lit(N_STEPS))
    return raw_audits(spark, sf).withColumn("audit", a).select("auditor", "condition", "item_id", "sample", F.col("audit").isNotNull().alias("parsed"), F.col("audit.reported_error").cast("int").alias("flag"))


def measured_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Answers to rates in one go: parsed, averaged by item, then by cell."""
    out = rates.rate_summary(rates.item_probabilities(_judged(spark, sf), CELL), CELL)
    return out.select(*CELL, rounded("far").alias("far"), rounded("n1").alias("n1"), rounded("parse_ok_rate").alias("parse_ok_rate"), "unparsed_items", "n_items")


def greedy_pass(spark: SparkSession, sf: str) -> DataFrame:
    """The first sample alone, as a pass at temperature 0."""
    out = rates.rate_summary(rates.item_probabilities(_judged(spark, sf).where("sample = 0"), CELL), CELL)
    return out.select(*CELL, F.lit("greedy").alias("pass"), rounded("far").alias("far"), rounded("parse_ok_rate").alias("parse_ok_rate"), "n_items")


def determinism_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Two passes at temperature 0 over R0: items that both parse, and the share that differ."""
    out = rates.pair_disagreement(_judged(spark, sf).where("condition = 'R0'"), ["auditor"])
    return out.select("auditor", F.col("n_pairs").alias("compared"), rounded("disagreement").alias("disagreement_rate"))


def run_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of which less than a share of samples parsed: stored all the same, then refused with a reason."""
    v = view(spark, sf, "ladder_verdicts").groupBy("auditor", "condition", "family").agg(F.avg(F.col("parsed").cast("double")).alias("ok"), F.count_if(F.col("confidence") > 0.9).alias("truncated"), F.count(F.lit(1)).alias("n_choices"))
    return v.select("auditor", "condition", "family", rounded("ok").alias("parse_ok_rate"), generation.guard(F.col("ok"), F.col("truncated"), F.col("n_choices"), 0.93).alias("refusal"))


def resampled_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Episode ids rebuilt for cells without them, with the refusals of unknown cells and of pools larger than a cell."""
    cells = view(spark, sf, "r4_verdicts").groupBy("auditor", "condition").agg(F.countDistinct("item_id").alias("n_items"))
    pools = spark.createDataFrame([("AS", 10), ("AO", 10), ("US", 10), ("UO", 10), ("AF", 10), ("AV", 100_000), ("AX", 7), ("R0", 0)], "condition string, pool long")
    out = cells.join(F.broadcast(pools), "condition", "left")
    said = F.when(F.col("condition") == "R0", "skipped").when(F.col("pool").isNull(), "unknown cell").when(F.col("pool") > F.col("n_items"), "pool larger than the cell").otherwise("rebuilt")
    return out.select("auditor", "condition", "n_items", said.alias("outcome"), rounded(F.when(said == "rebuilt", F.col("n_items") / F.col("pool"))).alias("targets_per_episode"))


QUERIES = {
    f.__name__: f
    for f in (
        injection_prompts, accepted_attempts, fault_pairs, yield_table, position_pairs, episode_pool, incorrect_pool, filler_requests, episode_items, kept_promises, measured_rates,
        greedy_pass, determinism_probe, run_guard, resampled_ids,
    )
}

_brief = lambda c: " ".join(f"WHEN {c} = '{k}' THEN {_text(v)}" for k, v in prompts.FAULT_BRIEFS.items())
_listing = "string_agg(concat('Step ', step_no, ': ', step_text), chr(10) ORDER BY step_no)"
INJECTION = (
    f"st AS (SELECT item_id, {_listing} AS numbered, count(*) AS n FROM trace_text GROUP BY item_id), kf AS (SELECT *, item_id % (n - 1) + 2 AS k, CASE WHEN item_id % 2 = 0 THEN 'local' ELSE 'structural' END AS family FROM st WHERE n >= 2), "
    "hn AS (SELECT kf.*, CASE WHEN t.has_claim THEN concat(chr(10), 'The target step asserts: (', t.a, '.0, ', t.b, '.0) joined by (''+'',) equals ', t.r, '.', chr(10)) ELSE chr(10) END AS hint FROM kf JOIN trace_text t ON t.item_id = kf.item_id AND t.step_no = kf.k), "
    f"us AS (SELECT item_id, k, family, concat('Correct solution:', chr(10), numbered, chr(10), chr(10), 'TARGET STEP: ', k, chr(10), hint, chr(10), CASE {_brief('family')} END, chr(10), chr(10), 'Return exactly ', n - k + 1, ' steps: the rewritten Step ', k, ' through Step ', n, ', separated by {faults.SENTINEL}, propagating the consequences so no later step is inconsistent.') AS t FROM hn)"
)
# The fault (k's result plus one) is accepted only at a trace's last step: an earlier one leaves the answer as it was.
OUTCOME = (
    f"{FAULT}, lt AS (SELECT f.item_id, bool_or(t.step_no > k AND t.has_claim AND t.a + t.b <> t.r) AS later_bad, bool_or(t.step_no = n AND t.has_claim) AS ends_claim, "
    "bool_or(t.step_no > k AND t.has_claim AND r0 NOT IN (a0, b0) AND r0 IN (t.a, t.b, t.r)) AS stale FROM (SELECT item_id, k, n, a AS a0, b AS b0, r AS r0 FROM fk) f JOIN trace_text t USING (item_id) GROUP BY f.item_id), "
    "why AS (SELECT item_id, list_filter([CASE WHEN stale THEN 'not propagated' END, CASE WHEN later_bad AND a + b = r + 1 THEN 'inconsistent arithmetic' END, CASE WHEN NOT ends_claim OR k < n THEN 'final answer' END], lambda x: x IS NOT NULL) AS reasons FROM fk JOIN lt USING (item_id))"
)
TRIES = (
    f"{OUTCOME}, tr AS (SELECT item_id, fam.f AS family, t.a AS attempt, CASE (item_id + t.a + fam.f) % 3 WHEN 0 THEN ['other'] WHEN 1 THEN ['step count'] ELSE reasons END AS reasons FROM why, (VALUES (1), (2), (3)) t(a), (VALUES (0), (1)) fam(f)), "
    "ac AS (SELECT item_id, family, min(attempt) FILTER (len(reasons) = 0) AS won FROM tr GROUP BY ALL)"
)
EP = "re AS (SELECT pos, item_id, request, repair, CASE WHEN pos % 7 <> 0 AND pos % 5 <> 0 THEN concat('{\"verdict\": \"', CASE WHEN pos % 3 = 0 THEN 'incorrect' ELSE 'correct' END, '\", \"confidence\": 0.5, \"first_error_step\": 1, \"evidence\": \"e', pos, '\"}') END AS audit FROM episodes), ok AS (SELECT * FROM re WHERE audit IS NOT NULL AND repair IS NOT NULL)"
LV = "ladder_verdicts"
PARTS = "item_p AS (SELECT auditor, condition, item_id, avg(CASE WHEN parsed THEN flag::DOUBLE END) AS p, count(CASE WHEN parsed THEN 1 END) AS np, count(*) AS ns FROM ladder_verdicts WHERE {} GROUP BY ALL)"
ORACLES = {
    "injection_prompts": _with(f"{INJECTION} SELECT item_id, k, family, length(t) AS chars, md5(t) AS digest FROM us", TT),
    "accepted_attempts": _with(
        f"{TRIES}, sn AS (SELECT tr.item_id, won, attempt, unnest(reasons) AS reason FROM tr JOIN ac USING (item_id, family) WHERE family = 0 AND (won IS NULL OR attempt < won)), cl AS (SELECT item_id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS classes FROM sn GROUP BY item_id) "
        "SELECT item_id, won IS NOT NULL AS accepted, coalesce(won, 0)::BIGINT AS attempt, coalesce(won, 3)::BIGINT AS tried, coalesce(classes, '') AS classes FROM ac LEFT JOIN cl USING (item_id) WHERE family = 0", TT),
    "fault_pairs": _with(f"{TRIES} SELECT item_id, count(won) = 2 AS complete, count(won) AS accepted FROM ac GROUP BY item_id", TT),
    "yield_table": _with(
        f"{TRIES}, by_ AS (SELECT item_id, bool_or(won IS NOT NULL AND family = 0) AS l, bool_or(won IS NOT NULL AND family = 1) AS s FROM ac GROUP BY item_id) "
        f"SELECT count(*) AS sources, count(*) FILTER (l) AS local_accepted, count(*) FILTER (s) AS structural_accepted, count(*) FILTER (l AND s) AS both_accepted, {R('count(*) FILTER (l AND s) / count(*)')} AS pair_rate, CASE WHEN count(*) FILTER (l AND s) / count(*) >= {PAIR_YIELD} THEN 'MET' ELSE 'NOT MET' END AS target FROM by_", TT),
    "position_pairs": _with(
        "fr AS (SELECT item_id, min(step_no) AS e, max(step_no) AS l, count(*) AS c FROM trace_text WHERE has_claim AND step_no >= 2 GROUP BY item_id), nn AS (SELECT item_id, max(step_no) AS n FROM trace_text GROUP BY item_id), ks AS (SELECT item_id, 'early' AS family, e AS k FROM fr WHERE c >= 2 UNION ALL SELECT item_id, 'late', l FROM fr WHERE c >= 2), "
        "ft AS (SELECT ks.item_id, family, k, n, a, b, r FROM ks JOIN nn USING (item_id) JOIN trace_text t ON t.item_id = ks.item_id AND t.step_no = k), "
        "jd AS (SELECT f.item_id, f.family, f.k, f.n, coalesce(bool_or(t.step_no > f.k AND t.has_claim AND ((f.r NOT IN (f.a, f.b) AND f.r IN (t.a, t.b, t.r)) OR (t.a + t.b <> t.r AND f.a + f.b = f.r + 1))), false) AS bad, bool_or(t.step_no = f.n AND t.has_claim) AS ends_claim FROM ft f JOIN trace_text t USING (item_id) GROUP BY f.item_id, f.family, f.k, f.n) "
        "SELECT item_id, count(*) FILTER (NOT bad AND k = n AND ends_claim) = 2 AS complete, count(*) FILTER (NOT bad AND k = n AND ends_claim) AS accepted FROM jd GROUP BY item_id", TT),
    "episode_pool": _with(f"{EP} SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, item_id, pos % 3 = 0 AS reported_error, length(audit) AS audit_chars, length(trim(repair)) AS repair_chars FROM ok", "episodes"),
    "incorrect_pool": _with(f"{EP}, nu AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS nth FROM ok), ic AS (SELECT * FROM nu WHERE pos % 3 = 0 ORDER BY pos LIMIT 20) SELECT count(*) AS episodes, 0::BIGINT AS violations, coalesce(max(nth), -1) AS last_pos FROM ic", "episodes"),
    "filler_requests": _with(
        f"{EP}, q AS (SELECT item_id, concat('Restate the following problem in your own words, in about ', greatest(30, round_even((length(audit) + length(trim(repair))) / 5.5::DOUBLE, 0))::BIGINT, ' words, without solving it.', chr(10), chr(10), coalesce(request, '')) AS f, greatest(30, round_even(length(trim(repair)) / 5.5::DOUBLE, 0))::BIGINT AS w FROM ok) "
        f"SELECT item_id, length(f) AS filler_chars, md5(f) AS filler_digest, concat({_text(prompts.NEUTRAL_REQUEST)}, ' Use about ', w, ' words.') AS neutral FROM q", "episodes"),
    "episode_items": _with("st AS (SELECT item_id, count(*) AS n FROM trace_text GROUP BY item_id) SELECT pos, CASE WHEN pos % 4 = 0 THEN 2 ELSE coalesce(n, 0) END AS n_steps, CASE WHEN pos % 4 = 0 THEN 'inline' WHEN n IS NULL THEN 'refused' ELSE 'lookup' END AS source FROM episodes LEFT JOIN st ON st.item_id = pos * 3 + 1", TT, "episodes"),
    "kept_promises": _with(
        f"m AS (SELECT * FROM (VALUES {', '.join(f'({_text(c)}, {_text(m)})' for c, m in PROMISED.items())}) t(condition, mode)) "
        "SELECT auditor, condition, mode, count(*) AS items, count(*) FILTER (mode <> 'delegated' AND length(trim(repair)) > 0) AS n_performed FROM ladder_verdicts v JOIN m USING (condition) LEFT JOIN episodes e ON e.pos = v.item_id WHERE sample = 0 GROUP BY ALL", LV, "episodes"),
    "measured_rates": _with(f"{PARTS.format('true')} SELECT auditor, condition, {R('avg(p)')} AS far, {R('avg(2 * CASE WHEN p > 1 - p THEN 1 - p ELSE p END)')} AS n1, {R('sum(np) / sum(ns)')} AS parse_ok_rate, count(*) FILTER (p IS NULL) AS unparsed_items, count(*) AS n_items FROM item_p GROUP BY ALL", LV),
    "greedy_pass": _with(f"{PARTS.format('sample = 0')} SELECT auditor, condition, 'greedy' AS pass, {R('avg(p)')} AS far, {R('sum(np) / sum(ns)')} AS parse_ok_rate, count(*) AS n_items FROM item_p GROUP BY ALL", LV),
    "determinism_probe": _with(f"g AS (SELECT auditor, item_id, max(CASE WHEN sample = 0 AND parsed THEN flag END) AS a, max(CASE WHEN sample = 1 AND parsed THEN flag END) AS b FROM ladder_verdicts WHERE condition = 'R0' GROUP BY ALL) SELECT auditor, count(*) AS compared, {R('avg((a <> b)::INT)')} AS disagreement_rate FROM g WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY auditor", LV),
    "run_guard": _with(
        f"g AS (SELECT auditor, condition, family, avg(parsed::INT) AS ok, count(*) FILTER (confidence > 0.9) AS tr, count(*) AS n FROM ladder_verdicts GROUP BY ALL) SELECT auditor, condition, family, {R('ok')} AS parse_ok_rate, "
        "CASE WHEN ok < 0.93 THEN concat('too few answers parsed (', printf('%.1f', round(ok * 100, 1)), '%): ', CASE WHEN tr > 0 THEN concat(tr, ' of ', n, ' answers were cut off, so their limit is too low') ELSE 'none was cut off, so look at what they say' END) END AS refusal FROM g", LV),
    "resampled_ids": _with(
        "c AS (SELECT auditor, condition, count(DISTINCT item_id) AS n_items FROM r4_verdicts GROUP BY ALL), p AS (SELECT * FROM (VALUES ('AS', 10), ('AO', 10), ('US', 10), ('UO', 10), ('AF', 10), ('AV', 100000), ('AX', 7), ('R0', 0)) t(condition, pool)), "
        "o AS (SELECT *, CASE WHEN condition = 'R0' THEN 'skipped' WHEN pool IS NULL THEN 'unknown cell' WHEN pool > n_items THEN 'pool larger than the cell' ELSE 'rebuilt' END AS outcome FROM c LEFT JOIN p USING (condition)) "
        f"SELECT auditor, condition, n_items, outcome, CASE WHEN outcome = 'rebuilt' THEN {R('n_items / pool')} END AS targets_per_episode FROM o", "r4_verdicts"),
}
