"""Rate, localisation, calibration and signal-detection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdictspark.functions.stats import probit_sql, rounded, smoothed_rate_sql
from verdictspark.operators import origins, rates
from verdictspark.sources.fixtures import oracle_views, table, view

CELL = ["auditor", "condition"]


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "ladder_verdicts")


def _with(sql: str, *names: str) -> str:
    return f"WITH {oracle_views(*names)}{', ' if not sql.lstrip().startswith('SELECT') else ' '}{sql}"


def item_report_prob(spark: SparkSession, sf: str) -> DataFrame:
    out = rates.item_probabilities(_verdicts(spark, sf), CELL)
    return out.select(*CELL, "item_id", rounded("p").alias("p"), "n_parsed")


ITEM_P = "item_p AS (SELECT auditor, condition, arm, item_id, avg(CASE WHEN parsed THEN flag::DOUBLE END) AS p, count(CASE WHEN parsed THEN 1 END) AS n_parsed, count(*) AS n_samples FROM ladder_verdicts GROUP BY ALL)"


def far_by_condition(spark: SparkSession, sf: str) -> DataFrame:
    clean = _verdicts(spark, sf).where("arm = 'clean'")
    out = rates.rate_summary(rates.item_probabilities(clean, CELL), CELL)
    return out.select(*CELL, rounded("far").alias("far"), rounded("n1").alias("n1"), rounded("parse_ok_rate").alias("parse_ok_rate"), "n_items")


def instability_n1(spark: SparkSession, sf: str) -> DataFrame:
    out = rates.rate_summary(rates.item_probabilities(_verdicts(spark, sf), ["auditor"]), ["auditor"])
    return out.select("auditor", rounded("n1").alias("n1"), (F.col("n1") < 0.25).alias("gate1_pass"))


def parse_rates(spark: SparkSession, sf: str) -> DataFrame:
    v = _verdicts(spark, sf)
    by_item = rates.rate_summary(rates.item_probabilities(v, CELL), CELL)
    usable = v.groupBy(*CELL).agg(F.count_if(F.col("parsed") & F.col("step").isNotNull()).alias("localizable_samples"))
    return by_item.join(usable, CELL).select(*CELL, rounded("parse_ok_rate").alias("parse_ok_rate"), "unparsed_items", "localizable_samples")


def modal_step(spark: SparkSession, sf: str) -> DataFrame:
    v = _verdicts(spark, sf).where("arm = 'incorrect'")
    return rates.modal_steps(v, [*CELL, "item_id"]).select(*CELL, "item_id", F.col("step").alias("modal_step"), "votes")


def mean_confidence(spark: SparkSession, sf: str) -> DataFrame:
    out = _verdicts(spark, sf).where("parsed").groupBy(*CELL, "item_id").agg(F.avg("confidence").alias("c"))
    return out.select(*CELL, "item_id", rounded("c").alias("confidence"))


def localisation_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    out = rates.localisation(_verdicts(spark, sf).where("arm = 'incorrect'"), [*CELL, "item_id"])
    return out.select(*CELL, "item_id", "usable", rounded("exact").alias("accuracy"))


def localisation_within_one(spark: SparkSession, sf: str) -> DataFrame:
    out = rates.localisation(_verdicts(spark, sf).where("arm = 'incorrect'"), CELL)
    return out.select(*CELL, "usable", rounded("exact").alias("exact"), rounded("within_one").alias("within_one"))


def ece_by_condition(spark: SparkSession, sf: str) -> DataFrame:
    v = _verdicts(spark, sf).where("arm = 'incorrect' and parsed")
    items = v.groupBy(*CELL, "item_id").agg(F.avg("confidence").alias("confidence"), F.avg(F.col("flag").cast("double")).alias("correct"))
    out = rates.expected_calibration_error(items, CELL)
    return out.select(*CELL, rounded("ece").alias("ece"), "n_pairs")


def greedy_disagreement(spark: SparkSession, sf: str) -> DataFrame:
    out = rates.pair_disagreement(_verdicts(spark, sf), CELL)
    return out.select(*CELL, "n_pairs", rounded("disagreement").alias("disagreement"))


def usage_summary(spark: SparkSession, sf: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    usage = table(spark, sf, "events").select(
        F.concat(F.lit("m"), F.col("event_id") % 3).alias("auditor"), F.lit(4.0).alias("n"), (F.col("value") * 4).alias("completion_tokens"),
        F.when(k % 25 == 0, "length").otherwise("stop").alias("finish_reason"),
    )
    out = rates.usage_summary(usage, ["auditor"])
    return out.select("auditor", *[rounded(c).alias(c) for c in ("mean_tokens", "p50_tokens", "p95_tokens", "max_tokens")], "truncated")


def arm_rates(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """hit and far (means of item means) and the items of either arm behind them."""
    items = rates.item_probabilities(verdicts, [*keys, "arm"])
    value = lambda arm: F.when(F.col("arm") == arm, F.col("p"))
    out = items.groupBy(*keys).agg(F.avg(value("incorrect")).alias("hit"), F.avg(value("clean")).alias("far"), F.count(value("incorrect")).alias("n_signal"), F.count(value("clean")).alias("n_noise"))
    return out.where("n_signal > 0 and n_noise > 0")


def sdt_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = rates.signal_detection(arm_rates(_verdicts(spark, sf), CELL))
    return out.select(*CELL, "n_signal", "n_noise", *[rounded(c).alias(c) for c in ("hit", "far", "d_prime", "criterion", "balanced_accuracy")])


def baseline_by_origin(spark: SparkSession, sf: str) -> DataFrame:
    """Each condition's false alarms against R0 of the first directory that lists it."""
    v = _verdicts(spark, sf).where("arm = 'clean'")
    v = v.withColumn("dir", F.when(F.col("family").isin("F1", "F2"), 0).otherwise(1)).where("not (auditor = 'm2' and condition = 'R0' and dir = 0)")
    v = v.where("condition <> 'R3' or dir = 1")
    cells = rates.item_probabilities(v, ["auditor", "condition", "dir"]).groupBy("auditor", "condition", "dir").agg(F.avg("p").alias("far"))
    kept = origins.first_listed(cells, ["auditor"], "dir").select("auditor", "condition", "far", "dir")
    base = cells.where("condition = 'R0'").select("auditor", "dir", F.col("far").alias("base"))
    out = kept.where("condition <> 'R0'").join(base, ["auditor", "dir"], "left")
    return out.select("auditor", "condition", "dir", rounded("far").alias("far"), rounded("base").alias("baseline_far"), F.col("base").isNotNull().alias("scorable"))


def paired_effects(spark: SparkSession, sf: str) -> DataFrame:
    """Mean paired difference from R0 over items with both probabilities."""
    p = rates.item_probabilities(_verdicts(spark, sf), CELL)
    r0 = p.where("condition = 'R0'").select("auditor", "item_id", F.col("p").alias("p0"))
    d = p.where("condition <> 'R0'").join(r0, ["auditor", "item_id"]).withColumn("d", F.col("p") - F.col("p0")).where("d is not null")
    out = d.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("effect"))
    return out.select(*CELL, "n", rounded("effect").alias("effect"))


R4_CELLS = ["R0", "AS", "AO", "US", "UO", "AF", "AV", "AN", "AX", "AXN"]


def r4_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each auditor and item with every cell's probability: one shuffle instead of ten joins."""
    p = rates.item_probabilities(view(spark, sf, "r4_verdicts"), ["auditor", "condition", "episode_id", "ax_episode_id"], parsed=None)
    return p.groupBy("auditor", "item_id", "episode_id", "ax_episode_id").pivot("condition", R4_CELLS).agg(F.first("p"))


def cell_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return r4_pivot(spark, sf).select("auditor", "item_id", *[rounded(c).alias(c.lower()) for c in R4_CELLS])


#: Contrasts of the factorial and its controls over pivoted cells.
CONTRASTS = {
    "placement_assistant_minus_user": "(AS_ + AO) / 2 - (US + UO) / 2",
    "attribution_self_minus_peer": "(AS_ + US) / 2 - (AO + UO) / 2",
    "interaction": "(AS_ - AO) - (US - UO)",
    "episode_presence_vs_r0": "(AS_ + AO + US + UO) / 4 - R0",
    "filler_vs_r0": "AF - R0",
    "episode_vs_filler": "(AS_ + AO + US + UO) / 4 - AF",
    "audit_only_vs_r0": "AV - R0",
    "repair_contribution_as_minus_av": "AS_ - AV",
    "audit_only_vs_filler": "AV - AF",
    "repair_contribution_as_minus_an": "AS_ - AN",
    "continuation_presence_av_minus_an": "AV - AN",
    "audit_plus_inert_vs_filler": "AN - AF",
    "incorrect_verdict_vs_r0": "AX - R0",
    "verdict_composition_ax_minus_as": "AX - AS_",
    "genuine_repair_ax_minus_axn": "AX - AXN",
    "polarity_axn_minus_an": "AXN - AN",
}


def contrast_items(pivot: DataFrame) -> DataFrame:
    """The pivoted cells unpivoted to long contrasts: auditor, item, both clusterings, contrast, d."""
    wide = pivot.withColumnRenamed("AS", "AS_")
    pairs = F.array(*[F.struct(F.lit(name).alias("contrast"), F.expr(text).cast("double").alias("d")) for name, text in CONTRASTS.items()])
    return wide.select("auditor", "item_id", "episode_id", "ax_episode_id", F.inline(pairs)).where("d is not null")


def r4_factorial_points(spark: SparkSession, sf: str) -> DataFrame:
    out = contrast_items(r4_pivot(spark, sf)).groupBy("auditor", "contrast").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("effect"))
    return out.select("auditor", "contrast", "n", rounded("effect").alias("effect"))


R4_ITEM = "r4_item AS (SELECT auditor, item_id, episode_id, ax_episode_id, " + ", ".join(f"avg(CASE WHEN condition = '{c}' THEN flag::DOUBLE END) AS {'AS_' if c == 'AS' else c}" for c in R4_CELLS) + " FROM r4_verdicts GROUP BY ALL)"
R4_LONG = "r4_long AS (" + " UNION ALL ".join(f"SELECT auditor, item_id, episode_id, ax_episode_id, '{n}' AS contrast, {e} AS d FROM r4_item WHERE ({e}) IS NOT NULL" for n, e in CONTRASTS.items()) + ")"
R = lambda e: f"round({e}, 6) + 0.0"


def baseline_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Data-quality refusals: items of each condition that R0 of the same auditor lacks."""
    p = rates.item_probabilities(_verdicts(spark, sf), CELL).select(*CELL, "item_id")
    r0 = p.where("condition = 'R0'").select("auditor", "item_id")
    lost = p.where("condition <> 'R0'").join(r0, ["auditor", "item_id"], "left_anti").groupBy(*CELL).agg(F.count(F.lit(1)).alias("missing"))
    cells = p.where("condition <> 'R0'").groupBy(*CELL).agg(F.count(F.lit(1)).alias("items"))
    return cells.join(lost, CELL, "left").select(*CELL, "items", F.coalesce("missing", F.lit(0)).cast("long").alias("missing"), (F.coalesce("missing", F.lit(0)) == 0).alias("aligned"))


def range_check(spark: SparkSession, sf: str) -> DataFrame:
    """Gate 2: detection on the incorrect arm inside [0.35, 0.90]."""
    out = arm_rates(_verdicts(spark, sf), CELL)
    verdict = F.when(F.col("hit") > 0.90, "too obvious").when(F.col("hit") < 0.35, "too hard").otherwise("in range")
    return out.select(*CELL, rounded("hit").alias("detection"), verdict.alias("gate2"))


def window_order(frame: DataFrame) -> DataFrame:
    """Conditions in ladder order, others behind them by name."""
    order = ["R0", "R0p", "R1", "R2", "R3", "R3u"]
    place = F.coalesce(*[F.when(F.col("condition") == c, F.lit(i)) for i, c in enumerate(order)], F.lit(99))
    return frame.withColumn("ord", F.row_number().over(Window.partitionBy("auditor").orderBy(place, "condition")))


def condition_order(spark: SparkSession, sf: str) -> DataFrame:
    return window_order(_verdicts(spark, sf).select(*CELL).distinct()).select(*CELL, F.col("ord").cast("long").alias("ord"))


QUERIES = {
    f.__name__: f
    for f in (
        item_report_prob, far_by_condition, instability_n1, parse_rates, modal_step, mean_confidence, localisation_accuracy, localisation_within_one,
        ece_by_condition, greedy_disagreement, usage_summary, sdt_metrics, baseline_by_origin, paired_effects, cell_pivot, r4_factorial_points,
        baseline_checks, range_check, condition_order,
    )
}

V = "ladder_verdicts"
ARMS = """arms AS (SELECT auditor, condition, avg(CASE WHEN arm = 'incorrect' THEN p END) AS hit, avg(CASE WHEN arm = 'clean' THEN p END) AS far,
  count(CASE WHEN arm = 'incorrect' THEN p END) AS n_signal, count(CASE WHEN arm = 'clean' THEN p END) AS n_noise FROM item_p GROUP BY ALL)"""
ORACLES = {
    "item_report_prob": _with(f"{ITEM_P} SELECT auditor, condition, item_id, {R('p')} AS p, n_parsed FROM item_p", V),
    "far_by_condition": _with(f"{ITEM_P} SELECT auditor, condition, {R('avg(p)')} AS far, {R('avg(2 * least(p, 1 - p))')} AS n1, {R('sum(n_parsed) / sum(n_samples)')} AS parse_ok_rate, count(*) AS n_items FROM item_p WHERE arm = 'clean' GROUP BY ALL", V),
    "instability_n1": _with(f"q AS (SELECT auditor, item_id, avg(CASE WHEN parsed THEN flag::DOUBLE END) AS p FROM {V} GROUP BY ALL) SELECT auditor, {R('avg(2 * least(p, 1 - p))')} AS n1, avg(2 * least(p, 1 - p)) < 0.25 AS gate1_pass FROM q GROUP BY ALL", V),
    "parse_rates": _with(f"{ITEM_P} SELECT auditor, condition, {R('sum(n_parsed) / sum(n_samples)')} AS parse_ok_rate, count(*) FILTER (p IS NULL) AS unparsed_items, (SELECT count(*) FROM {V} v WHERE v.auditor = item_p.auditor AND v.condition = item_p.condition AND parsed AND step IS NOT NULL) AS localizable_samples FROM item_p GROUP BY auditor, condition", V),
    "modal_step": _with(f"c AS (SELECT auditor, condition, item_id, step, count(*) AS votes, min(sample) AS f FROM {V} WHERE arm = 'incorrect' AND parsed AND step IS NOT NULL GROUP BY ALL) SELECT auditor, condition, item_id, step AS modal_step, votes FROM c QUALIFY row_number() OVER (PARTITION BY auditor, condition, item_id ORDER BY votes DESC, f) = 1", V),
    "mean_confidence": _with(f"SELECT auditor, condition, item_id, {R('avg(confidence)')} AS confidence FROM {V} WHERE parsed GROUP BY ALL", V),
    "localisation_accuracy": _with(f"SELECT auditor, condition, item_id, count(CASE WHEN parsed THEN step END) AS usable, {R('avg(CASE WHEN parsed AND step IS NOT NULL THEN (step = gold_label + 1)::INT::DOUBLE END)')} AS accuracy FROM {V} WHERE arm = 'incorrect' GROUP BY ALL", V),
    "localisation_within_one": _with(f"SELECT auditor, condition, count(CASE WHEN parsed THEN step END) AS usable, {R('avg(CASE WHEN parsed AND step IS NOT NULL THEN (step = gold_label + 1)::INT::DOUBLE END)')} AS exact, {R('avg(CASE WHEN parsed AND step IS NOT NULL THEN (abs(step - gold_label - 1) <= 1)::INT::DOUBLE END)')} AS within_one FROM {V} WHERE arm = 'incorrect' GROUP BY ALL", V),
    "ece_by_condition": _with(
        f"i AS (SELECT auditor, condition, item_id, avg(confidence) AS c, avg(flag::DOUBLE) AS a FROM {V} WHERE arm = 'incorrect' AND parsed GROUP BY ALL), "
        "b AS (SELECT auditor, condition, " + " + ".join(f"(c > {i} * 0.1::DOUBLE)::INT" for i in range(1, 10)) + " AS bin, count(*) AS n, avg(c) AS mc, avg(a) AS ma FROM i GROUP BY ALL) "
        f"SELECT auditor, condition, {R('sum(n * abs(mc - ma)) / sum(n)')} AS ece, sum(n)::BIGINT AS n_pairs FROM b GROUP BY ALL", V),
    "greedy_disagreement": _with(f"t AS (SELECT auditor, condition, item_id, max(CASE WHEN sample = 0 AND parsed THEN flag END) AS a, max(CASE WHEN sample = 1 AND parsed THEN flag END) AS b FROM {V} GROUP BY ALL) SELECT auditor, condition, count(*) AS n_pairs, {R('avg((a <> b)::INT::DOUBLE)')} AS disagreement FROM t WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL", V),
    "usage_summary": f"SELECT concat('m', event_id % 3) AS auditor, {R('avg(value * 4 / 4)')} AS mean_tokens, {R('quantile_cont(value * 4 / 4, 0.5)')} AS p50_tokens, {R('quantile_cont(value * 4 / 4, 0.95)')} AS p95_tokens, {R('max(value * 4 / 4)')} AS max_tokens, count(*) FILTER (CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 25 = 0) AS truncated FROM events GROUP BY 1",
    "sdt_metrics": _with(
        f"{ITEM_P}, {ARMS}, s AS (SELECT *, {smoothed_rate_sql('hit', 'n_signal')} AS h, {smoothed_rate_sql('far', 'n_noise')} AS f FROM arms WHERE n_signal > 0 AND n_noise > 0), z AS (SELECT *, {probit_sql('h')} AS zh, {probit_sql('f')} AS zf FROM s) "
        f"SELECT auditor, condition, n_signal, n_noise, {R('hit')} AS hit, {R('far')} AS far, {R('zh - zf')} AS d_prime, {R('-0.5 * (zh + zf)')} AS criterion, {R('0.5 * (hit + 1 - far)')} AS balanced_accuracy FROM z", V),
    "baseline_by_origin": _with(
        f"c AS (SELECT auditor, condition, CASE WHEN family IN ('F1', 'F2') THEN 0 ELSE 1 END AS dir, item_id, avg(CASE WHEN parsed THEN flag::DOUBLE END) AS p FROM {V} WHERE arm = 'clean' GROUP BY ALL), "
        "g AS (SELECT auditor, condition, dir, avg(p) AS far FROM c WHERE NOT (auditor = 'm2' AND condition = 'R0' AND dir = 0) AND (condition <> 'R3' OR dir = 1) GROUP BY ALL), "
        "k AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY auditor, condition ORDER BY dir) = 1) "
        f"SELECT k.auditor, k.condition, k.dir, {R('k.far')} AS far, {R('b.far')} AS baseline_far, b.far IS NOT NULL AS scorable FROM k LEFT JOIN g b ON b.auditor = k.auditor AND b.dir = k.dir AND b.condition = 'R0' WHERE k.condition <> 'R0'", V),
    "paired_effects": _with(f"q AS (SELECT auditor, condition, item_id, avg(CASE WHEN parsed THEN flag::DOUBLE END) AS p FROM {V} GROUP BY ALL) SELECT a.auditor, a.condition, count(*) AS n, {R('avg(a.p - b.p)')} AS effect FROM q a JOIN q b ON a.auditor = b.auditor AND a.item_id = b.item_id AND b.condition = 'R0' WHERE a.condition <> 'R0' AND a.p - b.p IS NOT NULL GROUP BY ALL", V),
    "cell_pivot": _with(f"{R4_ITEM} SELECT auditor, item_id, " + ", ".join(f"{R('AS_' if c == 'AS' else c)} AS {'\"as\"' if c == 'AS' else c.lower()}" for c in R4_CELLS) + " FROM r4_item", "r4_verdicts"),
    "r4_factorial_points": _with(f"{R4_ITEM}, {R4_LONG} SELECT auditor, contrast, count(*) AS n, {R('avg(d)')} AS effect FROM r4_long GROUP BY ALL", "r4_verdicts"),
    "baseline_checks": _with(f"i AS (SELECT DISTINCT auditor, condition, item_id FROM {V}) SELECT auditor, condition, count(*) AS items, count(*) FILTER (NOT has) AS missing, count(*) FILTER (NOT has) = 0 AS aligned FROM (SELECT a.*, EXISTS (SELECT 1 FROM i b WHERE b.auditor = a.auditor AND b.item_id = a.item_id AND b.condition = 'R0') AS has FROM i a WHERE a.condition <> 'R0') GROUP BY ALL", V),
    "range_check": _with(f"{ITEM_P}, {ARMS} SELECT auditor, condition, {R('hit')} AS detection, CASE WHEN hit > 0.90 THEN 'too obvious' WHEN hit < 0.35 THEN 'too hard' ELSE 'in range' END AS gate2 FROM arms WHERE n_signal > 0 AND n_noise > 0", V),
    "condition_order": _with(f"d AS (SELECT DISTINCT auditor, condition FROM {V}) SELECT auditor, condition, row_number() OVER (PARTITION BY auditor ORDER BY CASE condition WHEN 'R0' THEN 0 WHEN 'R0p' THEN 1 WHEN 'R1' THEN 2 WHEN 'R2' THEN 3 WHEN 'R3' THEN 4 WHEN 'R3u' THEN 5 ELSE 99 END, condition) AS ord FROM d", V),
}
