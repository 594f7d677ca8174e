"""Contrasts with intervals, declared families, decision rules and the reports on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictspark.functions.stats import probit_sql, rounded, smoothed_rate_sql
from verdictspark.operators import multiplicity, rates, resampling
from verdictspark.operators.resampling import SEED
from verdictspark.plans.rates import CELL, CONTRASTS, ITEM_P, R4_ITEM, R4_LONG, R, _with, arm_rates, contrast_items, r4_pivot
from verdictspark.sources.fixtures import view

#: Replicates of every registered bootstrap, as in the reference's analyse commands.
REPS = 20_000
#: Declared families: contrasts that a claim rests on, and the factorial ones.
CLAIMS = (
    "episode_vs_filler", "audit_only_vs_filler", "audit_plus_inert_vs_filler", "repair_contribution_as_minus_av",
    "repair_contribution_as_minus_an", "verdict_composition_ax_minus_as", "genuine_repair_ax_minus_axn", "polarity_axn_minus_an",
)
FACTORIAL = ("placement_assistant_minus_user", "attribution_self_minus_peer", "interaction")
PAIRWISE = (("R1", "R0p"), ("R2", "R1"), ("R3", "R2"), ("R3", "R3u"))
STATS = ("effect", "lo", "hi", "p", "p_centred")
V = "ladder_verdicts"


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, V)


def _stream(*columns: str):  # noqa: ANN202
    return F.concat_ws("/", *[F.col(c) for c in columns])


def _told(found: DataFrame, keys: list[str], *more: str) -> DataFrame:
    return found.select(*keys, *[rounded(c).alias(c) for c in STATS], *more)


def rung_differences(spark: SparkSession, sf: str) -> DataFrame:
    """d of every item and condition against R0, with its cluster."""
    p = rates.item_probabilities(_verdicts(spark, sf), [*CELL, "episode_id"])
    r0 = p.where("condition = 'R0'").select("auditor", "item_id", F.col("p").alias("p0"))
    return p.where("condition <> 'R0'").join(r0, ["auditor", "item_id"]).select(*CELL, "item_id", "episode_id", (F.col("p") - F.col("p0")).alias("d")).where("d is not null")


def rung_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return _told(resampling.bootstrap(rung_differences(spark, sf), CELL, "item_id", "d", REPS, _stream(*CELL)), CELL, "n", "n_clusters")


def cluster_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return _told(resampling.bootstrap(rung_differences(spark, sf), CELL, "episode_id", "d", REPS, _stream(*CELL)), CELL, "n", "n_clusters")


def ladder_pairwise(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring rungs against one another, outside the corrected family."""
    p = rates.item_probabilities(_verdicts(spark, sf), [*CELL, "episode_id"]).select(*CELL, "item_id", "episode_id", "p")
    pairs = spark.createDataFrame(PAIRWISE, "high string, low string")
    high = p.join(F.broadcast(pairs), F.col("condition") == F.col("high")).select("auditor", "item_id", "episode_id", "high", "low", F.col("p").alias("ph"))
    low = p.select("auditor", "item_id", F.col("condition").alias("low"), F.col("p").alias("pl"))
    d = high.join(low, ["auditor", "item_id", "low"]).select("auditor", F.concat("high", F.lit("-"), "low").alias("contrast"), "episode_id", (F.col("ph") - F.col("pl")).alias("d"))
    keys = ["auditor", "contrast"]
    return _told(resampling.bootstrap(d.where("d is not null"), keys, "episode_id", "d", REPS, _stream(*keys)), keys, "n")


def detection_vs_r0(spark: SparkSession, sf: str) -> DataFrame:
    d = rung_differences(spark, sf).where("item_id % 2 = 1")
    return _told(resampling.bootstrap(d, CELL, "episode_id", "d", REPS, F.concat(_stream(*CELL), F.lit("/detection"))), CELL, "n", "n_clusters")


def _deltas(frame: DataFrame) -> DataFrame:
    """d_prime, criterion and balanced accuracy of the condition less those of R0, all smoothed by the condition's arms."""
    for name, rate, n in (("h1", "h1", "n_signal"), ("h0", "h0", "n_signal"), ("f1", "f1", "n_noise"), ("f0", "f0", "n_noise")):
        frame = frame.withColumn(f"_s{name}", F.expr(smoothed_rate_sql(rate, n)))
    for name in ("h1", "h0", "f1", "f0"):
        frame = frame.withColumn(f"_z{name}", F.expr(probit_sql(f"_s{name}")))
    return (
        frame.withColumn("d_prime", (F.col("_zh1") - F.col("_zf1")) - (F.col("_zh0") - F.col("_zf0")))
        .withColumn("criterion", -0.5 * (F.col("_zh1") + F.col("_zf1")) + 0.5 * (F.col("_zh0") + F.col("_zf0")))
        .withColumn("balanced_accuracy", 0.5 * ((F.col("h1") - F.col("f1")) - (F.col("h0") - F.col("f0"))))
    )


def sdt_items(spark: SparkSession, sf: str, scope: tuple[str, ...]) -> DataFrame:
    """p1 of every item, condition and arm but R0's, with p0, that of R0."""
    cell = [*scope, "condition"]
    p = rates.item_probabilities(_verdicts(spark, sf), [*cell, "arm", "episode_id"])
    r0 = p.where("condition = 'R0'").select(*scope, "item_id", F.col("p").alias("p0"))
    return p.where("condition <> 'R0'").join(r0, [*scope, "item_id"], "left").withColumnRenamed("p", "p1")


def sdt_intervals(spark: SparkSession, sf: str, scope: tuple[str, ...] = ("auditor",)) -> DataFrame:
    return sdt_intervals_of(sdt_items(spark, sf, scope), [*scope, "condition"])


def sdt_intervals_of(items: DataFrame, cell: list[str]) -> DataFrame:
    """Intervals of the three differences; arms are drawn independently, conditions paired within them."""
    keys = [*cell, "arm"]
    table = resampling.clusters(items, keys, "episode_id", ["p0", "p1"])
    arm = lambda a, c: F.max(F.when(F.col("arm") == a, F.col(c)))
    wide = [arm("incorrect", "p1").alias("h1"), arm("incorrect", "p0").alias("h0"), arm("clean", "p1").alias("f1"), arm("clean", "p0").alias("f0")]
    sizes = items.groupBy(*cell).agg(F.count(F.when(F.col("arm") == "incorrect", F.col("p1"))).alias("n_signal"), F.count(F.when(F.col("arm") == "clean", F.col("p1"))).alias("n_noise"))
    point = table.groupBy(*keys).agg(*[F.try_divide(F.sum(f"s_{v}"), F.sum(f"n_{v}")).alias(v) for v in ("p0", "p1")]).groupBy(*cell).agg(*wide)
    reps = resampling.replicates(table, keys, ["p0", "p1"], REPS, _stream(*keys)).groupBy(*cell, "rep").agg(*wide)
    point, reps = _deltas(point.join(sizes, cell)), _deltas(reps.join(sizes, cell))
    names = ["d_prime", "criterion", "balanced_accuracy"]
    long = lambda f, *more: f.select(*cell, *more, F.inline(F.array(*[F.struct(F.lit(q).alias("quantity"), F.round(F.col(q), 12).alias("m")) for q in names]))).where("m is not null")
    effects = long(point).withColumnRenamed("m", "effect")
    return resampling.intervals(long(reps, "rep"), effects, [*cell, "quantity"], "m", REPS)


def sdt_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return _told(sdt_intervals(spark, sf), [*CELL, "quantity"])


def r4_intervals(spark: SparkSession, sf: str, cluster: str = "episode_id") -> DataFrame:
    keys = ["auditor", "contrast"]
    stream = F.concat_ws("/", F.col("auditor"), F.col("contrast"), F.lit(cluster))
    return resampling.bootstrap(contrast_items(r4_pivot(spark, sf)), keys, cluster, "d", REPS, stream)


def r4_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return _told(r4_intervals(spark, sf), ["auditor", "contrast"], "n", "n_clusters")


AX = ("incorrect_verdict_vs_r0", "verdict_composition_ax_minus_as", "genuine_repair_ax_minus_axn", "polarity_axn_minus_an")


def widest_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Contrasts of cells with different episode pools: the wider of both clusterings."""
    both = r4_intervals(spark, sf).withColumn("clustering", F.lit("episode_id"))
    both = both.unionByName(r4_intervals(spark, sf, "ax_episode_id").withColumn("clustering", F.lit("ordinary_ax")))
    out = resampling.widest(both.where(F.col("contrast").isin(*AX)), ["auditor", "contrast"], "clustering")
    return _told(out, ["auditor", "contrast"], "clustering")


def r4_families(spark: SparkSession, sf: str) -> DataFrame:
    found = r4_intervals(spark, sf)
    family = F.when(F.col("contrast").isin(*CLAIMS), "r4-claims").when(F.col("contrast").isin(*FACTORIAL), "r4-factorial")
    tests = found.withColumn("family", family).where("family is not null").withColumn("p", F.round("p", 9))
    return multiplicity.holm(tests, ["family"], F.concat_ws("/", "auditor", "contrast"))


def holm_r4_claims(spark: SparkSession, sf: str) -> DataFrame:
    return r4_families(spark, sf).select("family", "auditor", "contrast", rounded("p").alias("p"), F.col("k").cast("long"), F.col("rank").cast("long"), rounded("threshold", 9).alias("threshold"), "reject")


def family_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Members present against those declared (three auditors; the tables hold two)."""
    present = r4_families(spark, sf).groupBy("family").agg(F.count(F.lit(1)).alias("got"), F.array_join(F.array_sort(F.collect_set("contrast")), ",").alias("present"))
    declared = spark.createDataFrame([("r4-claims", len(CLAIMS) * 3), ("r4-factorial", len(FACTORIAL) * 2)], "family string, expected long")
    out = declared.join(present, "family", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    return out.select("family", "got", "expected", multiplicity.guard_message(F.col("got"), F.col("expected"), F.col("family"), F.coalesce("present", F.lit(""))).alias("message"))


def _bands(spark: SparkSession, sf: str) -> DataFrame:
    samples = _verdicts(spark, sf).where("condition = 'R0' and parsed").select("auditor", "item_id", "sample", "flag")
    return resampling.half_band(samples, ["auditor"], REPS, F.concat(F.col("auditor"), F.lit("/n2")))


def n2_band(spark: SparkSession, sf: str) -> DataFrame:
    return _bands(spark, sf).select("auditor", F.col("width").cast("long"), "n_items", rounded("band").alias("band"))


def gate3_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """A rung moved where its test survives correction and its effect exceeds the auditor's null band."""
    tests = resampling.bootstrap(rung_differences(spark, sf), CELL, "episode_id", "d", REPS, _stream(*CELL)).withColumn("p", F.round("p", 9))
    tests = multiplicity.holm(tests.withColumn("family", F.lit("gate3")), ["family"], F.concat_ws("/", *CELL))
    out = tests.join(F.broadcast(_bands(spark, sf).select("auditor", "band")), "auditor", "left")
    beats = F.coalesce(F.abs(F.round("effect", 9)) > F.round("band", 9), F.lit(False))
    return out.select(*CELL, rounded("effect").alias("effect"), rounded("p").alias("p"), rounded("band").alias("n2_band"), "reject", beats.alias("beats_n2"), F.when(F.col("reject") & beats, "MOVED").otherwise("no").alias("verdict"))


def sdt_reading(spark: SparkSession, sf: str) -> DataFrame:
    """What a fall of false alarms means, by rules fixed in advance."""
    found = sdt_intervals(spark, sf).withColumn("p", F.round("p", 9)).withColumn("family", F.concat_ws("/", "quantity", "auditor"))
    found = multiplicity.holm(found, ["family"], F.col("condition"))
    dp = found.where("quantity = 'd_prime'").select(*CELL, "effect", "p", "reject")
    a = arm_rates(_verdicts(spark, sf), CELL)
    base = a.where("condition = 'R0'").select("auditor", F.col("far").alias("far0"), F.col("hit").alias("hit0"))
    x = a.where("condition <> 'R0'").join(base, "auditor").join(dp, CELL, "left")
    dfar, ddet, up = F.round((F.col("far") - F.col("far0")) * 100, 6), F.round((F.col("hit") - F.col("hit0")) * 100, 6), F.round("effect", 9) > 0
    reading = (
        F.when(dfar >= -0.5, "false alarms did not fall").when(F.col("reject") & up, "improvement").when((F.col("p") <= 0.05) & up, "not corrected")
        .when(F.col("p") > 0.05, "threshold shift").when(ddet > 0, "discrimination").otherwise("mixed")
    )
    return x.select(*CELL, (dfar + 0.0).alias("dfar_pp"), (ddet + 0.0).alias("ddet_pp"), rounded("p").alias("p"), reading.alias("reading"))


def _passes(spark: SparkSession, sf: str) -> DataFrame:
    """R0 in two passes (even and odd samples) and three controls, by item."""
    v = _verdicts(spark, sf)
    name = (
        F.when((F.col("condition") == "R0") & (F.col("sample") % 2 == 0), "A").when(F.col("condition") == "R0", "B")
        .when(F.col("condition") == "R0p", "PC").when(F.col("condition") == "R1", "PCL").when(F.col("condition") == "R2", "PCH")
    )
    p = rates.item_probabilities(v.withColumn("pass", name).where("pass is not null"), ["auditor", "pass"])
    return p.groupBy("auditor", "item_id").pivot("pass", ["A", "B", "PC", "PCL", "PCH"]).agg(F.first("p"))


def gate0_screen(spark: SparkSession, sf: str) -> DataFrame:
    """Controls against the auditor's own sham band; the reference is R0 pooled over both passes."""
    wide = _passes(spark, sf).withColumn("ref", (F.col("A") + F.col("B")) / 2)
    parts = {"sham": "B - A", "PC": "PC - ref", "PCL": "PCL - ref", "PCH": "PCH - ref", "framing": "PC - PCL"}
    d = wide.select("auditor", "item_id", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.expr(e).alias("d")) for n, e in parts.items()]))).where("d is not null")
    found = resampling.bootstrap(d, ["auditor", "name"], "item_id", "d", REPS, _stream("auditor", "name"))
    get = lambda n, c: F.max(F.when(F.col("name") == n, F.round(F.col(c), 9)))
    row = found.groupBy("auditor").agg(
        F.greatest(F.abs(get("sham", "lo")), F.abs(get("sham", "hi"))).alias("band"), get("framing", "effect").alias("framing"),
        *[get(c, s).alias(f"{c}_{s}") for c in ("PC", "PCL", "PCH") for s in ("lo", "hi")],
    )
    clears = lambda c: (F.col(f"{c}_lo") > F.col("band")) | (F.col(f"{c}_hi") < -F.col("band"))
    verdict = F.when(~clears("PCH"), "FAIL: dead DV").when(~clears("PC") & ~clears("PCL"), "FAIL: framing unmeasurable").when(clears("PCL"), "PASS").otherwise("PASS (upward only)")
    return row.select("auditor", rounded("band").alias("own_band"), rounded("framing").alias("framing_range"), rounded(F.greatest(F.lit(0.03), F.abs("framing"))).alias("mde"), verdict.alias("gate0"))


def template_robustness(spark: SparkSession, sf: str) -> DataFrame:
    """R1 less R0p under every wording: robust where all signs agree and the mean is three standard deviations."""
    p = rates.item_probabilities(_verdicts(spark, sf), ["auditor", "family", "condition"])
    high = p.where("condition = 'R1'").select("auditor", "family", "item_id", F.col("p").alias("h"))
    low = p.where("condition = 'R0p'").select("auditor", "family", "item_id", F.col("p").alias("l"))
    e = high.join(low, ["auditor", "family", "item_id"]).where("h - l is not null").groupBy("auditor", "family").agg(F.avg(F.col("h") - F.col("l")).alias("e"), F.avg("l").alias("level"))
    e = e.withColumn("e", F.round("e", 9)).withColumn("level", F.round("level", 9))
    out = e.groupBy("auditor").agg(F.count(F.lit(1)).alias("n_wordings"), F.avg("e").alias("mean"), F.stddev_samp("e").alias("sd"), F.stddev_samp("level").alias("level_sd"), (F.bool_and(F.col("e") > 0) | F.bool_and(F.col("e") < 0)).alias("same_sign"))
    robust = F.col("same_sign") & (F.abs(F.try_divide("mean", "sd")) >= 3)
    return out.select("auditor", "n_wordings", rounded("mean").alias("mean_effect"), rounded("sd").alias("sd_effect"), rounded("level_sd").alias("sd_level"), "same_sign", F.when(robust, "ROBUST").otherwise("not robust").alias("verdict"))


def kill_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Spread over wordings, sham difference and strength of the positive control against 3 points."""
    by_wording = rates.item_probabilities(_verdicts(spark, sf).where("condition = 'R0'"), ["auditor", "family"]).groupBy("auditor", "family").agg(F.avg("p").alias("far"))
    sd = by_wording.groupBy("auditor").agg(F.stddev_samp("far").alias("template_sd"))
    far = _passes(spark, sf).groupBy("auditor").agg(*[F.avg(c).alias(c) for c in ("A", "B", "PC")])
    x = sd.join(far, "auditor").select("auditor", F.round("template_sd", 9).alias("sd"), F.round(F.abs(F.col("A") - F.col("B")), 9).alias("sham"), F.round(F.col("PC") - F.col("A"), 9).alias("pc"))
    fails = F.concat_ws("; ", F.when(F.col("sd") > 0.03, "template SD > MDE"), F.when(F.col("sham") > 0.03, "nuisance > MDE"), F.when(F.abs("pc") < 0.06, "PC too weak"))
    return x.select("auditor", rounded("sd").alias("template_sd"), rounded("sham").alias("sham"), rounded("pc").alias("pc_effect"), F.when(fails == "", "PASS").otherwise(fails).alias("verdict"))


def position_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Early less late by source: R1 and R2 stand for the positions; matched below a gap of 0.10."""
    p = rates.item_probabilities(_verdicts(spark, sf), CELL)
    wide = p.groupBy("auditor", "item_id").pivot("condition", ["R1", "R2"]).agg(F.first("p"))
    d = wide.select("auditor", "item_id", (F.col("R1") - F.col("R2")).alias("d")).where("d is not null")
    found = resampling.bootstrap(d, ["auditor"], "item_id", "d", REPS, F.concat(F.col("auditor"), F.lit("/position")))
    return _told(found, ["auditor"], "n").withColumn("reading", F.when(F.abs("effect") < 0.10, "MATCHED").otherwise("differs"))


REPORTED = ("episode_vs_filler", "placement_assistant_minus_user", "attribution_self_minus_peer")


def wording_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """The reported contrasts for each auditor and wording (items are dealt to wordings by id)."""
    d = contrast_items(r4_pivot(spark, sf)).where(F.col("contrast").isin(*REPORTED)).withColumn("wording", F.concat(F.lit("F"), 1 + F.col("item_id") % 5))
    keys = ["auditor", "wording", "contrast"]
    return resampling.bootstrap(d, keys, "item_id", "d", REPS, _stream(*keys))


def report_cell(effect, p):  # noqa: ANN001, ANN201
    """An effect in points, starred where p <= 0.05; --- where it is missing."""
    return F.coalesce(F.concat(F.format_string("%+.2f", F.round(effect * 100, 6)), F.when(F.round(p, 9) <= 0.05, "*").otherwise("")), F.lit("---"))


def allcombos_report(spark: SparkSession, sf: str) -> DataFrame:
    x = wording_intervals(spark, sf).groupBy("auditor", "wording")
    cell = lambda n: report_cell(F.max(F.when(F.col("contrast") == n, F.round(F.col("effect"), 9))), F.max(F.when(F.col("contrast") == n, F.col("p"))))
    return x.agg(*[cell(n).alias(n) for n in REPORTED])


def prose_counts(spark: SparkSession, sf: str) -> DataFrame:
    x = wording_intervals(spark, sf).withColumn("e", F.round("effect", 9)).withColumn("p", F.round("p", 9))
    sig = F.col("p") <= 0.05
    out = x.groupBy("contrast").agg(
        F.count(F.lit(1)).alias("combinations"), F.count_if(sig).alias("exclude_zero"), F.count_if(F.col("e") < 0).alias("negative"),
        F.min(F.when(sig, F.col("e") * 100)).alias("lo"), F.max(F.when(sig, F.col("e") * 100)).alias("hi"), F.coalesce(F.max(F.when(sig, F.col("p"))), F.lit(0.0)).alias("maxp"),
    )
    return out.select("contrast", "combinations", "exclude_zero", "negative", rounded("lo").alias("min_significant_pp"), rounded("hi").alias("max_significant_pp"), rounded("maxp").alias("max_p_significant"))


def quadrant_points(spark: SparkSession, sf: str) -> DataFrame:
    """Change of criterion and of d_prime for each auditor and condition, and whether the latter survives."""
    found = sdt_intervals(spark, sf).withColumn("p", F.round("p", 9)).withColumn("family", F.concat_ws("/", "quantity", "auditor"))
    found = multiplicity.holm(found, ["family"], F.col("condition"))
    get = lambda q, c: F.max(F.when(F.col("quantity") == q, F.col(c)))
    x = found.groupBy(*CELL).agg(get("criterion", "effect").alias("dc"), get("d_prime", "effect").alias("dd"), get("d_prime", "reject").alias("survives"))
    side = lambda c: F.when(F.round(c, 9) > 0, "+").otherwise("-")
    return x.select(*CELL, rounded("dc").alias("dc"), rounded("dd").alias("dd"), "survives", F.concat(side("dc"), side("dd")).alias("quadrant"))


QUERIES = {
    f.__name__: f
    for f in (
        rung_bootstrap, cluster_bootstrap, ladder_pairwise, detection_vs_r0, sdt_bootstrap, r4_bootstrap, widest_interval, holm_r4_claims, family_guard, n2_band,
        gate3_verdict, sdt_reading, gate0_screen, template_robustness, kill_tests, position_gap, allcombos_report, prose_counts, quadrant_points,
    )
}


def _draws(tag: str, keys: list[str], stream: str, values: list[str], reps: int = REPS) -> str:
    """CTEs of the oracle: cl_tag (clusters) must stand before; gives dr_tag and rp_tag."""
    k = ", ".join(keys)
    means = ", ".join(f"round(sum(s_{v}) / nullif(sum(n_{v}), 0), 12) AS {v}" for v in values)
    return (
        f"sz_{tag} AS (SELECT {k}, max(nk) AS nk, ('0x' || substr(md5(concat_ws(':', '{SEED}', {stream})), 1, 7))::BIGINT AS st FROM cl_{tag} GROUP BY {k}), "
        f"d0_{tag} AS (SELECT {k}, nk, rep, (st + rep * 1103515245 + j * 742938285 + 1) % 2147483647 AS x FROM (SELECT *, unnest(range(nk)) AS j FROM sz_{tag}, range({reps}) r(rep))), "
        f"d1_{tag} AS (SELECT {k}, nk, rep, xor(x, x >> 13) * 1597334677 % 2147483647 AS x FROM d0_{tag}), d2_{tag} AS (SELECT {k}, nk, rep, xor(x, x >> 16) * 823117891 % 2147483647 AS x FROM d1_{tag}), "
        f"dr_{tag} AS (SELECT {k}, rep, xor(x, x >> 15) % nk AS k FROM d2_{tag}), "
        f"rp_{tag} AS (SELECT {k}, rep, {means} FROM dr_{tag} JOIN cl_{tag} USING ({k}, k) GROUP BY {k}, rep)"
    )


def _clusters(tag: str, source: str, keys: list[str], cluster: str, values: list[str], where: str = "true") -> str:
    k = ", ".join(keys)
    sums = ", ".join(f"sum({v}::DOUBLE) AS s_{v}, count({v}) AS n_{v}" for v in values)
    return (
        f"cl_{tag} AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY c) - 1 AS k, count(*) OVER (PARTITION BY {k}) AS nk "
        f"FROM (SELECT {k}, {cluster} AS c, {sums} FROM {source} WHERE {where} GROUP BY ALL))"
    )


def _interval(tag: str, keys: list[str], value: str, reps_from: str, effects_from: str) -> str:
    k = ", ".join(keys)
    return (
        f"iv_{tag} AS (SELECT {k}, first(effect) AS effect, quantile_cont({value}, 0.025) AS lo, quantile_cont({value}, 0.975) AS hi, "
        f"greatest(2 * least(avg(({value} <= 0)::INT), 1 - avg(({value} <= 0)::INT)), 1 / {REPS}) AS p, "
        f"greatest(avg((abs({value} - effect) >= abs(effect) - 1e-9)::INT), 1 / {REPS}) AS p_centred FROM {reps_from} JOIN {effects_from} USING ({k}) GROUP BY {k})"
    )


def boot(tag: str, source: str, keys: list[str], cluster: str, stream: str) -> str:
    """All CTEs of a bootstrap of d; iv_tag and ef_tag hold the results."""
    k = ", ".join(keys)
    return ", ".join((
        _clusters(tag, source, keys, cluster, ["d"], "d IS NOT NULL"), _draws(tag, keys, stream, ["d"]),
        f"ef_{tag} AS (SELECT {k}, sum(s_d) / sum(n_d) AS effect, sum(n_d)::BIGINT AS n, max(nk) AS n_clusters FROM cl_{tag} GROUP BY {k})",
        _interval(tag, keys, "d", f"rp_{tag}", f"ef_{tag}"),
    ))


TOLD = ", ".join(f"{R(c)} AS {c}" for c in STATS)
ITEMS = f"q AS (SELECT auditor, condition, item_id, episode_id, avg(CASE WHEN parsed THEN flag::DOUBLE END) AS p FROM {V} GROUP BY ALL)"
DIFF = f"{ITEMS}, df AS (SELECT a.auditor, a.condition, a.item_id, a.episode_id, a.p - b.p AS d FROM q a JOIN q b ON a.auditor = b.auditor AND a.item_id = b.item_id AND b.condition = 'R0' WHERE a.condition <> 'R0')"
S2 = "concat_ws('/', auditor, condition)"
def sdt_sql(scope: tuple[str, ...] = ("auditor",), items: str | None = None) -> str:
    """CTEs of sdt_intervals; iv_s holds the results. items gives other CTEs that end in `it`."""
    k = ", ".join([*scope, "condition"])
    same = " AND ".join(f"a.{c} = b.{c}" for c in (*scope, "item_id"))
    own = ", ".join(f"a.{c}" for c in (*scope, "condition", "arm", "episode_id"))
    keys = [*scope, "condition"]
    return ", ".join((
        items or f"qa AS (SELECT {k}, arm, item_id, episode_id, avg(CASE WHEN parsed THEN flag::DOUBLE END) AS p FROM {V} GROUP BY ALL), "
        f"it AS (SELECT {own}, a.p AS p1, b.p AS p0 FROM qa a LEFT JOIN qa b ON {same} AND b.condition = 'R0' WHERE a.condition <> 'R0')",
        _clusters("s", "it", [*keys, "arm"], "episode_id", ["p0", "p1"]),
        _draws("s", [*keys, "arm"], f"concat_ws('/', {k}, arm)", ["p0", "p1"]),
        f"ns AS (SELECT {k}, count(CASE WHEN arm = 'incorrect' THEN p1 END) AS n_signal, count(CASE WHEN arm = 'clean' THEN p1 END) AS n_noise FROM it GROUP BY ALL)",
        f"al AS (SELECT {k}, arm, -1 AS rep, sum(s_p0) / nullif(sum(n_p0), 0) AS p0, sum(s_p1) / nullif(sum(n_p1), 0) AS p1 FROM cl_s GROUP BY ALL UNION ALL SELECT {k}, arm, rep, p0, p1 FROM rp_s)",
        f"wd AS (SELECT {k}, rep, max(CASE WHEN arm = 'incorrect' THEN p1 END) AS h1, max(CASE WHEN arm = 'incorrect' THEN p0 END) AS h0, max(CASE WHEN arm = 'clean' THEN p1 END) AS f1, max(CASE WHEN arm = 'clean' THEN p0 END) AS f0 FROM al GROUP BY ALL)",
        f"sm AS (SELECT *, {smoothed_rate_sql('h1', 'n_signal')} AS sh1, {smoothed_rate_sql('h0', 'n_signal')} AS sh0, {smoothed_rate_sql('f1', 'n_noise')} AS sf1, {smoothed_rate_sql('f0', 'n_noise')} AS sf0 FROM wd JOIN ns USING ({k}))",
        f"zz AS (SELECT *, {probit_sql('sh1')} AS zh1, {probit_sql('sh0')} AS zh0, {probit_sql('sf1')} AS zf1, {probit_sql('sf0')} AS zf0 FROM sm)",
        f"lg AS (SELECT {k}, rep, 'd_prime' AS quantity, round((zh1 - zf1) - (zh0 - zf0), 12) AS m FROM zz UNION ALL SELECT {k}, rep, 'criterion', round(-0.5 * (zh1 + zf1) + 0.5 * (zh0 + zf0), 12) FROM zz UNION ALL SELECT {k}, rep, 'balanced_accuracy', round(0.5 * ((h1 - f1) - (h0 - f0)), 12) FROM zz)",
        f"le AS (SELECT {k}, quantity, m AS effect FROM lg WHERE rep = -1 AND m IS NOT NULL), lr AS (SELECT * FROM lg WHERE rep >= 0 AND m IS NOT NULL)",
        _interval("s", [*keys, "quantity"], "m", "lr", "le"),
    ))


SDT = sdt_sql()


def _holm(source: str, family: str, order: str) -> str:
    """hm: source with k, rank, threshold and reject."""
    return (
        f"h1_ AS (SELECT *, count(*) OVER (PARTITION BY {family}) AS k, row_number() OVER (PARTITION BY {family} ORDER BY p, {order}) AS rank FROM {source}), "
        "h2_ AS (SELECT *, 0.05::DOUBLE / (k - rank + 1) AS threshold FROM h1_), "
        f"hm AS (SELECT *, min((p <= threshold)::INT) OVER (PARTITION BY {family} ORDER BY rank ROWS UNBOUNDED PRECEDING) = 1 AS reject FROM h2_)"
    )


R4BOOT = f"{R4_ITEM}, {R4_LONG}, " + boot("r", "r4_long", ["auditor", "contrast"], "episode_id", "concat_ws('/', auditor, contrast, 'episode_id')")
_quoted = lambda names: ", ".join(f"'{n}'" for n in names)
FAMILIES = f"{R4BOOT}, ts AS (SELECT auditor, contrast, round(p, 9) AS p, CASE WHEN contrast IN ({_quoted(CLAIMS)}) THEN 'r4-claims' WHEN contrast IN ({_quoted(FACTORIAL)}) THEN 'r4-factorial' END AS family FROM iv_r), tf AS (SELECT * FROM ts WHERE family IS NOT NULL), " + _holm("tf", "family", "concat_ws('/', auditor, contrast)")
N2 = ", ".join((
    f"b0 AS (SELECT auditor, item_id, flag, row_number() OVER (PARTITION BY auditor, item_id ORDER BY sample) - 1 AS s, count(*) OVER (PARTITION BY auditor, item_id) AS w FROM {V} WHERE condition = 'R0' AND parsed)",
    "b1 AS (SELECT *, max(w) OVER (PARTITION BY auditor) AS width FROM b0)",
    "b2 AS (SELECT auditor, item_id, width, avg(CASE WHEN s < width // 2 THEN flag::DOUBLE END) - avg(CASE WHEN s >= width // 2 AND s < 2 * (width // 2) THEN flag::DOUBLE END) AS d FROM b1 WHERE w = width AND width >= 2 GROUP BY ALL)",
    _clusters("n", "b2", ["auditor"], "item_id", ["d"]), _draws("n", ["auditor"], "concat(auditor, '/n2')", ["d"]),
    "bw AS (SELECT auditor, max(width) AS width, count(*) AS n_items FROM b2 GROUP BY ALL)",
    "bd AS (SELECT auditor, width, n_items, quantile_cont(abs(d), 0.95) / sqrt(width / (width // 2)) AS band FROM rp_n JOIN bw USING (auditor) GROUP BY auditor, width, n_items)",
))
PASSES = f"""ps AS (SELECT auditor, item_id, CASE WHEN condition = 'R0' AND sample % 2 = 0 THEN 'A' WHEN condition = 'R0' THEN 'B' WHEN condition = 'R0p' THEN 'PC' WHEN condition = 'R1' THEN 'PCL' WHEN condition = 'R2' THEN 'PCH' END AS pass, parsed, flag FROM {V}),
pi AS (SELECT auditor, item_id, pass, avg(CASE WHEN parsed THEN flag::DOUBLE END) AS p FROM ps WHERE pass IS NOT NULL GROUP BY ALL),
pw AS (SELECT auditor, item_id, """ + ", ".join(f"max(CASE WHEN pass = '{c}' THEN p END) AS {c}" for c in ("A", "B", "PC", "PCL", "PCH")) + " FROM pi GROUP BY ALL)"
WORDINGS = f"{R4_ITEM}, {R4_LONG}, wl AS (SELECT auditor, concat('F', 1 + item_id % 5) AS wording, contrast, item_id, d FROM r4_long WHERE contrast IN ({_quoted(REPORTED)})), " + boot("w", "wl", ["auditor", "wording", "contrast"], "item_id", "concat_ws('/', auditor, wording, contrast)")
ARMS = """arms AS (SELECT auditor, condition, avg(CASE WHEN arm = 'incorrect' THEN p END) AS hit, avg(CASE WHEN arm = 'clean' THEN p END) AS far FROM item_p GROUP BY ALL)"""
SDT_HOLM = f"{SDT}, sq AS (SELECT auditor, condition, quantity, effect, round(p, 9) AS p FROM iv_s), " + _holm("sq", "quantity, auditor", "condition")
CELLTEXT = lambda n: f"coalesce(max(CASE WHEN contrast = '{n}' THEN printf('%+.2f', round(round(effect, 9) * 100, 6)) || CASE WHEN round(p, 9) <= 0.05 THEN '*' ELSE '' END END), '---') AS {n}"

ORACLES = {
    "rung_bootstrap": _with(f"{DIFF}, {boot('a', 'df', CELL, 'item_id', S2)} SELECT auditor, condition, {TOLD}, n, n_clusters FROM iv_a JOIN (SELECT auditor, condition, n, n_clusters FROM ef_a) USING (auditor, condition)", V),
    "cluster_bootstrap": _with(f"{DIFF}, {boot('a', 'df', CELL, 'episode_id', S2)} SELECT auditor, condition, {TOLD}, n, n_clusters FROM iv_a JOIN (SELECT auditor, condition, n, n_clusters FROM ef_a) USING (auditor, condition)", V),
    "ladder_pairwise": _with(f"{ITEMS}, pw AS (SELECT a.auditor, concat(a.condition, '-', b.condition) AS contrast, a.episode_id, a.p - b.p AS d FROM q a JOIN q b ON a.auditor = b.auditor AND a.item_id = b.item_id WHERE (a.condition, b.condition) IN (('R1', 'R0p'), ('R2', 'R1'), ('R3', 'R2'), ('R3', 'R3u'))), {boot('a', 'pw', ['auditor', 'contrast'], 'episode_id', 'concat_ws(chr(47), auditor, contrast)')} SELECT auditor, contrast, {TOLD}, n FROM iv_a JOIN (SELECT auditor, contrast, n FROM ef_a) USING (auditor, contrast)", V),
    "detection_vs_r0": _with(f"{DIFF}, d1 AS (SELECT * FROM df WHERE item_id % 2 = 1), {boot('a', 'd1', CELL, 'episode_id', 'concat(' + S2 + ', chr(47), $$detection$$)')} SELECT auditor, condition, {TOLD}, n, n_clusters FROM iv_a JOIN (SELECT auditor, condition, n, n_clusters FROM ef_a) USING (auditor, condition)", V),
    "sdt_bootstrap": _with(f"{SDT} SELECT auditor, condition, quantity, {TOLD} FROM iv_s", V),
    "r4_bootstrap": _with(f"{R4BOOT} SELECT auditor, contrast, {TOLD}, n, n_clusters FROM iv_r JOIN (SELECT auditor, contrast, n, n_clusters FROM ef_r) USING (auditor, contrast)", "r4_verdicts"),
    "widest_interval": _with(
        f"{R4BOOT}, {boot('x', 'r4_long', ['auditor', 'contrast'], 'ax_episode_id', 'concat_ws(chr(47), auditor, contrast, $$ax_episode_id$$)')}, bo AS (SELECT *, 'episode_id' AS clustering FROM iv_r UNION ALL SELECT *, 'ordinary_ax' FROM iv_x) "
        f"SELECT auditor, contrast, {TOLD}, clustering FROM bo WHERE contrast IN ({_quoted(AX)}) QUALIFY row_number() OVER (PARTITION BY auditor, contrast ORDER BY round(hi - lo, 12) DESC, clustering) = 1", "r4_verdicts"),
    "holm_r4_claims": _with(f"{FAMILIES} SELECT family, auditor, contrast, {R('p')} AS p, k, rank, round(threshold, 9) AS threshold, reject FROM hm", "r4_verdicts"),
    "family_guard": _with(
        f"{FAMILIES}, dc AS (SELECT * FROM (VALUES ('r4-claims', {len(CLAIMS) * 3}::BIGINT), ('r4-factorial', {len(FACTORIAL) * 2}::BIGINT)) t(family, expected)), gt AS (SELECT family, count(*) AS got, string_agg(DISTINCT contrast, ',' ORDER BY contrast) AS present FROM hm GROUP BY ALL) "
        "SELECT family, coalesce(got, 0) AS got, expected, CASE WHEN coalesce(got, 0) <> expected THEN concat('family ', family, ' has ', coalesce(got, 0), ' members, ', expected, ' are declared: tested at 0.05/', coalesce(got, 0), ', ', CASE WHEN got < expected THEN 'more lenient' ELSE 'stricter' END, ' than declared; present: ', coalesce(present, '')) END AS message FROM dc LEFT JOIN gt USING (family)", "r4_verdicts"),
    "n2_band": _with(f"{N2} SELECT auditor, width, n_items, {R('band')} AS band FROM bd", V),
    "gate3_verdict": _with(
        f"{DIFF}, {boot('a', 'df', CELL, 'episode_id', S2)}, {N2}, g AS (SELECT auditor, condition, effect, round(p, 9) AS p, 1 AS family FROM iv_a), {_holm('g', 'family', S2)} "
        f"SELECT hm.auditor, condition, {R('effect')} AS effect, {R('p')} AS p, {R('band')} AS n2_band, reject, coalesce(abs(round(effect, 9)) > round(band, 9), false) AS beats_n2, CASE WHEN reject AND abs(round(effect, 9)) > round(band, 9) THEN 'MOVED' ELSE 'no' END AS verdict FROM hm LEFT JOIN bd USING (auditor)", V),
    "sdt_reading": _with(
        f"{SDT_HOLM}, {ITEM_P}, {ARMS}, rd AS (SELECT a.auditor, a.condition, round((a.far - b.far) * 100, 6) AS dfar_pp, round((a.hit - b.hit) * 100, 6) AS ddet_pp, hm.p, hm.effect, hm.reject FROM arms a JOIN arms b ON a.auditor = b.auditor AND b.condition = 'R0' LEFT JOIN hm ON hm.auditor = a.auditor AND hm.condition = a.condition AND hm.quantity = 'd_prime' WHERE a.condition <> 'R0') "
        f"SELECT auditor, condition, dfar_pp + 0.0 AS dfar_pp, ddet_pp + 0.0 AS ddet_pp, {R('p')} AS p, CASE WHEN dfar_pp >= -0.5 THEN 'false alarms did not fall' WHEN reject AND round(effect, 9) > 0 THEN 'improvement' WHEN p <= 0.05 AND round(effect, 9) > 0 THEN 'not corrected' WHEN p > 0.05 THEN 'threshold shift' WHEN ddet_pp > 0 THEN 'discrimination' ELSE 'mixed' END AS reading FROM rd", V),
    "gate0_screen": _with(
        f"{PASSES}, pl AS (SELECT auditor, item_id, unnest([{{'name': 'sham', 'd': B - A}}, {{'name': 'PC', 'd': PC - (A + B) / 2}}, {{'name': 'PCL', 'd': PCL - (A + B) / 2}}, {{'name': 'PCH', 'd': PCH - (A + B) / 2}}, {{'name': 'framing', 'd': PC - PCL}}], recursive := true) FROM pw), "
        f"{boot('g', 'pl', ['auditor', 'name'], 'item_id', 'concat_ws(chr(47), auditor, name)')}, gr AS (SELECT auditor, greatest(abs(max(CASE WHEN name = 'sham' THEN round(lo, 9) END)), abs(max(CASE WHEN name = 'sham' THEN round(hi, 9) END))) AS band, max(CASE WHEN name = 'framing' THEN round(effect, 9) END) AS framing, "
        + ", ".join(f"max(CASE WHEN name = '{c}' THEN round({s}, 9) END) AS {c}_{s}" for c in ("PC", "PCL", "PCH") for s in ("lo", "hi")) + " FROM iv_g GROUP BY ALL) "
        f"SELECT auditor, {R('band')} AS own_band, {R('framing')} AS framing_range, {R('greatest(0.03, abs(framing))')} AS mde, CASE WHEN NOT (PCH_lo > band OR PCH_hi < -band) THEN 'FAIL: dead DV' WHEN NOT (PC_lo > band OR PC_hi < -band) AND NOT (PCL_lo > band OR PCL_hi < -band) THEN 'FAIL: framing unmeasurable' WHEN PCL_lo > band OR PCL_hi < -band THEN 'PASS' ELSE 'PASS (upward only)' END AS gate0 FROM gr", V),
    "template_robustness": _with(
        f"t AS (SELECT auditor, family, condition, item_id, avg(CASE WHEN parsed THEN flag::DOUBLE END) AS p FROM {V} GROUP BY ALL), e AS (SELECT a.auditor, a.family, round(avg(a.p - b.p), 9) AS e, round(avg(b.p), 9) AS l FROM t a JOIN t b USING (auditor, family, item_id) WHERE a.condition = 'R1' AND b.condition = 'R0p' AND a.p - b.p IS NOT NULL GROUP BY ALL) "
        f"SELECT auditor, count(*) AS n_wordings, {R('avg(e)')} AS mean_effect, {R('stddev_samp(e)')} AS sd_effect, {R('stddev_samp(l)')} AS sd_level, bool_and(e > 0) OR bool_and(e < 0) AS same_sign, CASE WHEN (bool_and(e > 0) OR bool_and(e < 0)) AND abs(avg(e) / nullif(stddev_samp(e), 0)) >= 3 THEN 'ROBUST' ELSE 'not robust' END AS verdict FROM e GROUP BY ALL", V),
    "kill_tests": _with(
        f"{PASSES}, t AS (SELECT auditor, family, item_id, avg(CASE WHEN parsed THEN flag::DOUBLE END) AS p FROM {V} WHERE condition = 'R0' GROUP BY ALL), u AS (SELECT auditor, family, avg(p) AS far FROM t GROUP BY ALL), s AS (SELECT auditor, round(stddev_samp(far), 9) AS sd FROM u GROUP BY ALL), "
        "f AS (SELECT auditor, round(abs(avg(A) - avg(B)), 9) AS sham, round(avg(PC) - avg(A), 9) AS pc FROM pw GROUP BY ALL) "
        f"SELECT auditor, {R('sd')} AS template_sd, {R('sham')} AS sham, {R('pc')} AS pc_effect, coalesce(nullif(concat_ws('; ', CASE WHEN sd > 0.03 THEN 'template SD > MDE' END, CASE WHEN sham > 0.03 THEN 'nuisance > MDE' END, CASE WHEN abs(pc) < 0.06 THEN 'PC too weak' END), ''), 'PASS') AS verdict FROM s JOIN f USING (auditor)", V),
    "position_gap": _with(
        f"{ITEMS}, pg AS (SELECT a.auditor, a.item_id, a.p - b.p AS d FROM q a JOIN q b ON a.auditor = b.auditor AND a.item_id = b.item_id AND a.condition = 'R1' AND b.condition = 'R2'), {boot('a', 'pg', ['auditor'], 'item_id', 'concat(auditor, $$/position$$)')} "
        f"SELECT auditor, {TOLD}, n, CASE WHEN abs(round(effect, 6)) < 0.10 THEN 'MATCHED' ELSE 'differs' END AS reading FROM iv_a JOIN (SELECT auditor, n FROM ef_a) USING (auditor)", V),
    "allcombos_report": _with(f"{WORDINGS} SELECT auditor, wording, {', '.join(CELLTEXT(n) for n in REPORTED)} FROM iv_w GROUP BY ALL", "r4_verdicts"),
    "prose_counts": _with(
        f"{WORDINGS}, x AS (SELECT contrast, round(effect, 9) AS e, round(p, 9) AS p FROM iv_w) SELECT contrast, count(*) AS combinations, count(*) FILTER (p <= 0.05) AS exclude_zero, count(*) FILTER (e < 0) AS negative, "
        f"{R('min(CASE WHEN p <= 0.05 THEN e * 100 END)')} AS min_significant_pp, {R('max(CASE WHEN p <= 0.05 THEN e * 100 END)')} AS max_significant_pp, {R('coalesce(max(CASE WHEN p <= 0.05 THEN p END), 0)')} AS max_p_significant FROM x GROUP BY ALL", "r4_verdicts"),
    "quadrant_points": _with(
        f"{SDT_HOLM}, x AS (SELECT auditor, condition, max(CASE WHEN quantity = 'criterion' THEN effect END) AS dc, max(CASE WHEN quantity = 'd_prime' THEN effect END) AS dd, bool_or(reject) FILTER (quantity = 'd_prime') AS survives FROM hm GROUP BY ALL) "
        f"SELECT auditor, condition, {R('dc')} AS dc, {R('dd')} AS dd, survives, concat(CASE WHEN round(dc, 9) > 0 THEN '+' ELSE '-' END, CASE WHEN round(dd, 9) > 0 THEN '+' ELSE '-' END) AS quadrant FROM x", V),
}
