"""Readings fixed in advance, reports by wording, plotted rows and refusals over scored contrasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictspark.functions.stats import rounded
from verdictspark.operators import multiplicity, origins, rates, resampling
from verdictspark.plans import inference
from verdictspark.plans.inference import CLAIMS, FACTORIAL, FAMILIES, PASSES, R4BOOT, REPS, TOLD, V, _holm, _passes, _quoted, _stream, _told, _verdicts, boot, r4_families, r4_intervals, rung_differences, sdt_intervals, sdt_sql
from verdictspark.plans.rates import CELL, R4_ITEM, R4_LONG, R, _with, contrast_items, r4_pivot

#: Rows of the forest of contrasts: contrast, whether a claim rests on it, panel.
FOREST = (
    ("episode_presence_vs_r0", False, "g0"), ("episode_vs_filler", False, "g0"), ("audit_only_vs_filler", False, "g0"), ("repair_contribution_as_minus_an", True, "g1"),
    ("continuation_presence_av_minus_an", False, "g1"), ("genuine_repair_ax_minus_axn", True, "g1"), ("verdict_composition_ax_minus_as", True, "g1"),
    ("placement_assistant_minus_user", False, "g2"), ("attribution_self_minus_peer", False, "g2"),
)
PANELS = (("R3-R2", "R3", "R2"), ("R2-R1", "R2", "R1"))
WORDINGS = ("F1", "F2", "F3", "F4", "F5")
#: Models that the screen removed from every family of claims.
SCREENED = ("m1",)
#: Conditions that count as prior context; the tables hold none, so the last rung stands for one.
PRIOR = ("R3",)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Every contrast with its effect, p and whether it survives: its family's correction, or p alone outside of one."""
    found = r4_intervals(spark, sf).select("auditor", "contrast", F.round("effect", 9).alias("effect"), F.round("p", 9).alias("p"))
    tested = r4_families(spark, sf).select("auditor", "contrast", "reject")
    return found.join(tested, ["auditor", "contrast"], "left").withColumn("survives", F.coalesce("reject", F.col("p") <= 0.05))


def r4_readings(spark: SparkSession, sf: str) -> DataFrame:
    """What the factorial and its controls say, by rules fixed in advance."""
    names = {
        "ep": "episode_presence_vs_r0", "fl": "filler_vs_r0", "av": "audit_only_vs_r0", "rep": "repair_contribution_as_minus_av", "an": "repair_contribution_as_minus_an",
        "vc": "verdict_composition_ax_minus_as", "gr": "genuine_repair_ax_minus_axn", "pl": "placement_assistant_minus_user", "at": "attribution_self_minus_peer",
    }
    get = lambda n, c: F.max(F.when(F.col("contrast") == names[n], F.col(c)))
    wide = _scored(spark, sf).groupBy("auditor").agg(*[get(n, c).alias(f"{n}_{c}") for n in names for c in ("effect", "survives", "p")])
    e, s = lambda n: F.col(f"{n}_effect"), lambda n: F.col(f"{n}_survives")
    same = lambda n: (e(n) > 0) == (e("ep") > 0)
    share = lambda n: F.try_divide(F.abs(e(n)), F.abs(e("ep")))
    one: list[tuple[str, Column, Column]] = [
        ("filler", F.when(s("fl") & same("fl") & (F.coalesce(share("fl"), F.lit(1e9)) > 0.5), "confounded").when(s("fl") & same("fl"), "partly confounded").otherwise("content"), share("fl")),
        ("repair against audit only", F.when(~s("rep"), "adds nothing").when(same("rep"), "carries part").otherwise("opposite"), share("av")),
        ("repair against continuation", F.when(~s("an"), "adds nothing").otherwise("contributes"), e("an")),
        ("verdict", F.when(~s("vc"), "no priming").when(e("vc") > 0, "priming").otherwise("opposite to priming"), e("vc")),
        ("genuine repair", F.when(~s("gr"), "adds nothing").otherwise("contributes"), e("gr")),
        ("placement", F.when(F.col("pl_p") <= 0.05, "moves").otherwise("null"), e("pl")),
        ("attribution", F.when(F.col("at_p") <= 0.05, "moves").otherwise("null"), e("at")),
    ]
    rows = F.array(*[F.struct(F.lit(t).alias("topic"), r.alias("reading"), F.round(x, 6).alias("size")) for t, r, x in one])
    return wide.select("auditor", F.inline(rows)).select("auditor", "topic", "reading", (F.col("size") + 0.0).alias("size"))


def _by_wording(spark: SparkSession, sf: str) -> DataFrame:
    """d_prime and criterion of each wording, corrected within it; each wording is a set of families of its own."""
    found = sdt_intervals(spark, sf, ("auditor", "family")).withColumn("p", F.round("p", 9)).withColumn("effect", F.round("effect", 9))
    return multiplicity.holm(found, ["family", "quantity", "auditor"], F.col("condition"))


def detection_by_wording(spark: SparkSession, sf: str) -> DataFrame:
    """Change of d_prime at each wording, marked where it survives, with means and the number that do; six digits, which round alike everywhere."""
    x = _by_wording(spark, sf)
    dp = F.col("quantity") == "d_prime"
    signed = lambda v: F.format_string("%+.6f", F.round(v, 6))
    cell = lambda w: F.coalesce(F.max(F.when(dp & (F.col("family") == w), F.concat(signed(F.col("effect")), F.when(F.col("reject"), "+").otherwise("")))), F.lit("---")).alias(w)
    mean = lambda q: F.coalesce(signed(F.round(F.avg(F.when(F.col("quantity") == q, F.col("effect"))), 9)), F.lit("---"))
    survived = F.concat(F.count_if(dp & F.col("reject")).cast("string"), F.lit("/"), F.count_if(dp).cast("string"))
    return x.groupBy("auditor", "condition").agg(*[cell(w) for w in WORDINGS], mean("d_prime").alias("mean_d_prime"), survived.alias("survived"), mean("criterion").alias("mean_criterion"))


def directional_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Contrasts of d_prime over all wordings: how many fall, survive, and both; rungs and prior context apart."""
    x = _by_wording(spark, sf).where("quantity = 'd_prime'").withColumn("scope", F.when(F.col("condition").isin(*PRIOR), "prior-context").otherwise("ladder"))
    down = F.col("effect") < 0
    return x.groupBy("scope").agg(F.count(F.lit(1)).alias("contrasts"), F.count_if(down).alias("negative"), F.count_if("reject").alias("survive"), F.count_if(F.col("reject") & down).alias("degradations"))


def forest_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The plotted contrasts in points; one that a model lacks has no row."""
    rows = spark.createDataFrame([(k, *r) for k, r in enumerate(FOREST)], "ord int, contrast string, claim boolean, panel string")
    x = r4_intervals(spark, sf).join(F.broadcast(rows), "contrast")
    points = lambda c: (F.round(F.col(c) * 100, 6) + 0.0).alias(f"{c}_pp")
    return x.select("auditor", "contrast", F.col("ord").cast("long").alias("ord"), "claim", "panel", points("effect"), points("lo"), points("hi"), "n", rounded("p").alias("p"))


def _wording_pairs(spark: SparkSession, sf: str, pairs: tuple[tuple[str, str, str], ...]) -> DataFrame:
    p = rates.item_probabilities(_verdicts(spark, sf), ["auditor", "family", "condition"]).select("auditor", "family", "condition", "item_id", "p")
    table = F.broadcast(spark.createDataFrame(list(pairs), "panel string, high string, low string"))
    high = p.join(table, F.col("condition") == F.col("high")).select("panel", "auditor", "family", "item_id", "low", F.col("p").alias("ph"))
    low = p.select("auditor", "family", "item_id", F.col("condition").alias("low"), F.col("p").alias("pl"))
    return high.join(low, ["auditor", "family", "item_id", "low"]).withColumn("d", F.col("ph") - F.col("pl"))


def template_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """R1 less R0p with an interval at each wording, a stream for each."""
    d = _wording_pairs(spark, sf, (("R1-R0p", "R1", "R0p"),)).where("d is not null")
    keys = ["auditor", "family"]
    return _told(resampling.bootstrap(d, keys, "item_id", "d", REPS, F.concat(_stream(*keys), F.lit("/template"))), keys, "n")


def wording_panels(spark: SparkSession, sf: str) -> DataFrame:
    """Plotted rows of two contrasts by wording, in points."""
    keys = ["panel", "auditor", "family"]
    found = resampling.bootstrap(_wording_pairs(spark, sf, PANELS).where("d is not null"), keys, "item_id", "d", REPS, _stream(*keys))
    return found.select(*keys, *[(F.round(F.col(c) * 100, 6) + 0.0).alias(f"{c}_pp") for c in ("effect", "lo", "hi")])


CONTROLS = ("PC", "PCL", "PCH")


def pooled_band(spark: SparkSession, sf: str) -> DataFrame:
    """Controls against the widest sham interval of all auditors."""
    wide = _passes(spark, sf).withColumn("ref", (F.col("A") + F.col("B")) / 2)
    parts = {"sham": "B - A", **{c: f"{c} - ref" for c in CONTROLS}}
    d = wide.select("auditor", "item_id", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.expr(e).alias("d")) for n, e in parts.items()]))).where("d is not null")
    found = resampling.bootstrap(d, ["auditor", "name"], "item_id", "d", REPS, F.concat(_stream("auditor", "name"), F.lit("/pooled")))
    found = found.select("auditor", "name", *[F.round(c, 9).alias(c) for c in ("effect", "lo", "hi")])
    band = found.where("name = 'sham'").agg(F.max(F.greatest(F.abs("lo"), F.abs("hi"))).alias("band"))
    x = found.where("name <> 'sham'").crossJoin(F.broadcast(band))
    beats = (F.col("lo") > F.col("band")) | (F.col("hi") < -F.col("band"))
    return x.select("auditor", F.col("name").alias("control"), *[rounded(c).alias(c) for c in ("effect", "lo", "hi", "band")], F.when(beats, "yes").otherwise("no").alias("beats_sham"))


def gate3_framing(spark: SparkSession, sf: str) -> DataFrame:
    """Rungs that moved against their auditor's framing range: a larger effect is suspect."""
    moved = inference.gate3_verdict(spark, sf).select(*CELL, "effect", "verdict")
    framing = inference.gate0_screen(spark, sf).select("auditor", F.abs("framing_range").alias("framing_range"))
    x = moved.join(F.broadcast(framing), "auditor", "left").withColumn("within_framing_range", F.abs("effect") <= F.col("framing_range"))
    note = F.when((F.col("verdict") == "MOVED") & ~F.col("within_framing_range"), "exceeds framing range: suspect").otherwise("")
    return x.select(*CELL, "effect", "verdict", "framing_range", "within_framing_range", F.coalesce(note, F.lit("")).alias("note"))


def sdt_families(spark: SparkSession, sf: str) -> DataFrame:
    """Families of signal-detection tests: the ladder's by auditor and quantity, prior context by quantity."""
    scope = F.when(F.col("condition").isin(*PRIOR), "prior-context").otherwise(F.concat(F.lit("ladder/"), "auditor"))
    found = sdt_intervals(spark, sf).withColumn("p", F.round("p", 9)).withColumn("family", F.concat_ws("/", scope, "quantity"))
    found = multiplicity.holm(found, ["family"], F.concat_ws("/", *CELL))
    return found.select("family", *CELL, F.col("k").cast("long").alias("k"), rounded("p").alias("p"), "reject")


def prior_context_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Prior-context families against the declared three cells of every auditor."""
    x = sdt_families(spark, sf)
    expected = 3 * x.select("auditor").distinct().count()
    got = x.where("family like 'prior-context/%'").groupBy("family").agg(F.count(F.lit(1)).alias("got"), F.array_join(F.array_sort(F.collect_set("condition")), ",").alias("present"))
    said = multiplicity.guard_message(F.col("got"), F.lit(expected).cast("long"), F.col("family"), F.col("present"))
    return got.select("family", "got", F.lit(expected).cast("long").alias("expected"), said.alias("message"))


def screened_families(spark: SparkSession, sf: str) -> DataFrame:
    """The declared families without the models that the screen removed."""
    family = F.when(F.col("contrast").isin(*CLAIMS), "r4-claims").when(F.col("contrast").isin(*FACTORIAL), "r4-factorial")
    tests = r4_intervals(spark, sf).where(~F.col("auditor").isin(*SCREENED)).withColumn("family", family).where("family is not null").withColumn("p", F.round("p", 9))
    found = multiplicity.holm(tests, ["family"], F.concat_ws("/", "auditor", "contrast"))
    return found.select("family", "auditor", "contrast", F.col("k").cast("long").alias("k"), rounded("p").alias("p"), "reject")


def rung_bootstrap_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Rungs against R0, clustered by episode where the rung's items have episode ids, by item elsewhere. Only R2 and R3 were recorded with ids."""
    d = rung_differences(spark, sf).withColumn("episode_id", F.when(F.col("condition").isin("R2", "R3"), F.col("episode_id")))
    units = resampling.unit_by_ids(d, CELL)
    found = resampling.bootstrap(units, CELL, "unit", "d", REPS, F.concat(_stream(*CELL), F.lit("/ids")))
    return _told(found.join(F.broadcast(units.select(*CELL, "clustered").distinct()), CELL), CELL, "n", "n_clusters", "clustered")


def r4_item_only(spark: SparkSession, sf: str) -> DataFrame:
    """The factorial contrasts by items beside the clustered interval."""
    keys = ["auditor", "contrast"]
    d = contrast_items(r4_pivot(spark, sf)).where(F.col("contrast").isin(*FACTORIAL))
    both = None
    for unit in ("item_id", "episode_id"):
        found = resampling.bootstrap(d, keys, unit, "d", REPS, F.concat_ws("/", *keys, F.lit(unit))).select(*keys, *[rounded(c).alias(c) for c in ("effect", "lo", "hi", "p")], F.lit(unit).alias("unit"))
        both = found if both is None else both.unionByName(found)
    return both


def _placed_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts with the place of the directory that lists them: F1 and F2 stand for the first; it lacks m2's R0 and everyone's R3."""
    v = _verdicts(spark, sf).withColumn("place", F.when(F.col("family").isin("F1", "F2"), 0).otherwise(1))
    return v.where("arm <> 'clean' or not (auditor = 'm2' and condition = 'R0' and place = 0) and (condition <> 'R3' or place = 1)")


def sdt_by_origin(spark: SparkSession, sf: str) -> DataFrame:
    """Point differences against R0 of the directory that the condition's clean arm comes from; without one there is no score."""
    v = _placed_verdicts(spark, sf)
    cells = rates.item_probabilities(v.where("arm = 'clean'"), ["auditor", "condition", "place"]).groupBy("auditor", "condition", "place").agg(F.avg("p").alias("far"), F.count("p").alias("n"))
    kept = origins.first_listed(cells, ["auditor"]).select(*CELL, "place", F.col("far").alias("f1"), F.col("n").alias("n_noise"))
    base = cells.where("condition = 'R0'").select("auditor", "place", F.col("far").alias("f0"))
    hits = rates.item_probabilities(v.where("arm = 'incorrect'"), CELL).groupBy(*CELL).agg(F.avg("p").alias("h1"), F.count("p").alias("n_signal"))
    h0 = hits.where("condition = 'R0'").select("auditor", F.col("h1").alias("h0"))
    x = kept.where("condition <> 'R0'").join(base, ["auditor", "place"], "left").join(hits, CELL).join(h0, "auditor")
    out = inference._deltas(x)
    return out.select(*CELL, F.col("place").alias("dir"), F.col("f0").isNotNull().alias("scorable"), *[rounded(c).alias(c) for c in ("d_prime", "criterion", "balanced_accuracy")])


def sdt_bootstrap_by_origin(spark: SparkSession, sf: str) -> DataFrame:
    """The differences with intervals, each replicate's noise baseline drawn from the condition's own directory. Conditions of directories without R0 have none."""
    v = _placed_verdicts(spark, sf)
    clean = origins.against_own_baseline(rates.item_probabilities(v.where("arm = 'clean'"), [*CELL, "place", "episode_id"]), ["auditor"])
    signal = rates.item_probabilities(v.where("arm = 'incorrect'"), [*CELL, "episode_id"])
    r0 = signal.where("condition = 'R0'").select("auditor", "item_id", F.col("p").alias("p0"))
    signal = signal.where("condition <> 'R0'").join(clean.select(*CELL).distinct(), CELL, "left_semi").join(r0, ["auditor", "item_id"], "left")
    columns = [*CELL, "arm", "episode_id", F.col("p").alias("p1"), "p0"]
    items = clean.withColumn("arm", F.lit("clean")).select(*columns).unionByName(signal.withColumn("arm", F.lit("incorrect")).select(*columns))
    return _told(inference.sdt_intervals_of(items, CELL), [*CELL, "quantity"])


QUERIES = {
    f.__name__: f
    for f in (
        sdt_by_origin, sdt_bootstrap_by_origin, r4_readings, detection_by_wording, directional_counts, forest_rows, template_bootstrap, wording_panels, pooled_band, gate3_framing, sdt_families, prior_context_guard,
        screened_families, rung_bootstrap_by_ids, r4_item_only,
    )
}

SCORED = f"{FAMILIES}, sc AS (SELECT i.auditor, i.contrast, round(i.effect, 9) AS effect, round(i.p, 9) AS p, coalesce(hm.reject, round(i.p, 9) <= 0.05) AS ok FROM iv_r i LEFT JOIN hm ON hm.auditor = i.auditor AND hm.contrast = i.contrast)"
_get = lambda n, c: f"max(CASE WHEN contrast = '{n}' THEN {c} END)"
READ = f"""{SCORED}, wd AS (SELECT auditor, {_get('episode_presence_vs_r0', 'effect')} AS ep, {_get('filler_vs_r0', 'effect')} AS fl, bool_or(ok) FILTER (contrast = 'filler_vs_r0') AS fl_ok, {_get('audit_only_vs_r0', 'effect')} AS av,
{_get('repair_contribution_as_minus_av', 'effect')} AS rep, bool_or(ok) FILTER (contrast = 'repair_contribution_as_minus_av') AS rep_ok, {_get('repair_contribution_as_minus_an', 'effect')} AS an, bool_or(ok) FILTER (contrast = 'repair_contribution_as_minus_an') AS an_ok,
{_get('verdict_composition_ax_minus_as', 'effect')} AS vc, bool_or(ok) FILTER (contrast = 'verdict_composition_ax_minus_as') AS vc_ok, {_get('genuine_repair_ax_minus_axn', 'effect')} AS gr, bool_or(ok) FILTER (contrast = 'genuine_repair_ax_minus_axn') AS gr_ok,
{_get('placement_assistant_minus_user', 'effect')} AS pl, {_get('placement_assistant_minus_user', 'p')} AS pl_p, {_get('attribution_self_minus_peer', 'effect')} AS tt, {_get('attribution_self_minus_peer', 'p')} AS tt_p FROM sc GROUP BY auditor)"""
_P = "avg(CASE WHEN parsed THEN flag::DOUBLE END) AS p"
ORIGIN_SDT = sdt_sql(items=(
    f"vp AS (SELECT *, CASE WHEN family IN ('F1', 'F2') THEN 0 ELSE 1 END AS place FROM {V}), "
    f"qc AS (SELECT auditor, condition, place, item_id, episode_id, {_P} FROM vp WHERE arm = 'clean' AND NOT (auditor = 'm2' AND condition = 'R0' AND place = 0) AND (condition <> 'R3' OR place = 1) GROUP BY ALL), "
    f"qi AS (SELECT auditor, condition, item_id, episode_id, {_P} FROM {V} WHERE arm = 'incorrect' GROUP BY ALL), "
    "f0 AS (SELECT auditor, condition, min(place) AS place FROM qc GROUP BY ALL), fp AS (SELECT * FROM f0 WHERE (auditor, place) IN (SELECT (auditor, place) FROM qc WHERE condition = 'R0')), "
    "it AS (SELECT a.auditor, a.condition, 'clean' AS arm, a.episode_id, a.p AS p1, b.p AS p0 FROM qc a JOIN fp USING (auditor, condition, place) LEFT JOIN qc b ON b.auditor = a.auditor AND b.place = a.place AND b.item_id = a.item_id AND b.condition = 'R0' WHERE a.condition <> 'R0' "
    "UNION ALL SELECT a.auditor, a.condition, 'incorrect', a.episode_id, a.p, b.p FROM qi a JOIN fp USING (auditor, condition) LEFT JOIN qi b ON b.auditor = a.auditor AND b.item_id = a.item_id AND b.condition = 'R0' WHERE a.condition <> 'R0')"
))
BYW = f"{sdt_sql(('auditor', 'family'))}, sq AS (SELECT auditor, family, condition, quantity, round(effect, 9) AS effect, round(p, 9) AS p FROM iv_s), " + _holm("sq", "family, quantity, auditor", "condition")
_cell = lambda w: f"coalesce(max(CASE WHEN quantity = 'd_prime' AND family = '{w}' THEN printf('%+.6f', round(effect, 6)) || CASE WHEN reject THEN '+' ELSE '' END END), '---') AS {w}"
_mean = lambda q: f"coalesce(printf('%+.6f', round(round(avg(CASE WHEN quantity = '{q}' THEN effect END), 9), 6)), '---')"
WP = f"t AS (SELECT auditor, family, condition, item_id, avg(CASE WHEN parsed THEN flag::DOUBLE END) AS p FROM {V} GROUP BY ALL)"
PP = ", ".join(f"round({c} * 100, 6) + 0.0 AS {c}_pp" for c in ("effect", "lo", "hi"))
_in_prior = f"condition IN ({_quoted(PRIOR)})"
SFAM = f"{sdt_sql()}, sq AS (SELECT auditor, condition, quantity, round(p, 9) AS p, concat_ws('/', CASE WHEN {_in_prior} THEN 'prior-context' ELSE concat('ladder/', auditor) END, quantity) AS family FROM iv_s), " + _holm("sq", "family", "concat_ws('/', auditor, condition)")
_s = inference.smoothed_rate_sql
_z = inference.probit_sql
ORACLES = {
    "sdt_bootstrap_by_origin": _with(f"{ORIGIN_SDT} SELECT auditor, condition, quantity, {TOLD} FROM iv_s", V),
    "sdt_by_origin": _with(
        f"c AS (SELECT auditor, condition, CASE WHEN family IN ('F1', 'F2') THEN 0 ELSE 1 END AS dir, item_id, avg(CASE WHEN parsed THEN flag::DOUBLE END) AS p FROM {V} WHERE arm = 'clean' GROUP BY ALL), "
        "g AS (SELECT auditor, condition, dir, avg(p) AS far, count(p) AS n FROM c WHERE NOT (auditor = 'm2' AND condition = 'R0' AND dir = 0) AND (condition <> 'R3' OR dir = 1) GROUP BY ALL), "
        "k AS (SELECT auditor, condition, dir, far AS f1, n AS n_noise FROM g QUALIFY row_number() OVER (PARTITION BY auditor, condition ORDER BY dir) = 1), "
        f"hq AS (SELECT auditor, condition, item_id, avg(CASE WHEN parsed THEN flag::DOUBLE END) AS p FROM {V} WHERE arm = 'incorrect' GROUP BY ALL), hh AS (SELECT auditor, condition, avg(p) AS h1, count(p) AS n_signal FROM hq GROUP BY ALL), "
        "x AS (SELECT k.auditor, k.condition, k.dir, f1, g.far AS f0, hh.h1, b.h1 AS h0, hh.n_signal, n_noise FROM k LEFT JOIN g ON g.auditor = k.auditor AND g.dir = k.dir AND g.condition = 'R0' JOIN hh ON hh.auditor = k.auditor AND hh.condition = k.condition JOIN hh b ON b.auditor = k.auditor AND b.condition = 'R0' WHERE k.condition <> 'R0'), "
        f"sm AS (SELECT *, {_s('h1', 'n_signal')} AS sh1, {_s('h0', 'n_signal')} AS sh0, {_s('f1', 'n_noise')} AS sf1, {_s('f0', 'n_noise')} AS sf0 FROM x), zz AS (SELECT *, {_z('sh1')} AS zh1, {_z('sh0')} AS zh0, {_z('sf1')} AS zf1, {_z('sf0')} AS zf0 FROM sm) "
        f"SELECT auditor, condition, dir, f0 IS NOT NULL AS scorable, {R('(zh1 - zf1) - (zh0 - zf0)')} AS d_prime, {R('-0.5 * (zh1 + zf1) + 0.5 * (zh0 + zf0)')} AS criterion, {R('0.5 * ((h1 - f1) - (h0 - f0))')} AS balanced_accuracy FROM zz", V),
    "r4_readings": _with(
        f"{READ}, ws AS (SELECT *, abs(fl) / nullif(abs(ep), 0) AS sh, abs(av) / nullif(abs(ep), 0) AS sa FROM wd), o AS ("
        "SELECT auditor, 'filler' AS topic, CASE WHEN fl_ok AND (fl > 0) = (ep > 0) AND coalesce(sh, 1e9) > 0.5 THEN 'confounded' WHEN fl_ok AND (fl > 0) = (ep > 0) THEN 'partly confounded' ELSE 'content' END AS reading, sh AS size FROM ws UNION ALL "
        "SELECT auditor, 'repair against audit only', CASE WHEN NOT rep_ok THEN 'adds nothing' WHEN (rep > 0) = (ep > 0) THEN 'carries part' ELSE 'opposite' END, sa FROM ws UNION ALL "
        "SELECT auditor, 'repair against continuation', CASE WHEN NOT an_ok THEN 'adds nothing' ELSE 'contributes' END, an FROM ws UNION ALL "
        "SELECT auditor, 'verdict', CASE WHEN NOT vc_ok THEN 'no priming' WHEN vc > 0 THEN 'priming' ELSE 'opposite to priming' END, vc FROM ws UNION ALL "
        "SELECT auditor, 'genuine repair', CASE WHEN NOT gr_ok THEN 'adds nothing' ELSE 'contributes' END, gr FROM ws UNION ALL "
        "SELECT auditor, 'placement', CASE WHEN pl_p <= 0.05 THEN 'moves' ELSE 'null' END, pl FROM ws UNION ALL SELECT auditor, 'attribution', CASE WHEN tt_p <= 0.05 THEN 'moves' ELSE 'null' END, tt FROM ws) "
        f"SELECT auditor, topic, reading, {R('size')} AS size FROM o", "r4_verdicts"),
    "detection_by_wording": _with(
        f"{BYW} SELECT auditor, condition, {', '.join(_cell(w) for w in WORDINGS)}, {_mean('d_prime')} AS mean_d_prime, concat(count(*) FILTER (quantity = 'd_prime' AND reject), '/', count(*) FILTER (quantity = 'd_prime')) AS survived, {_mean('criterion')} AS mean_criterion FROM hm GROUP BY ALL", V),
    "directional_counts": _with(
        f"{BYW} SELECT CASE WHEN {_in_prior} THEN 'prior-context' ELSE 'ladder' END AS scope, count(*) AS contrasts, count(*) FILTER (effect < 0) AS negative, count(*) FILTER (reject) AS survive, count(*) FILTER (reject AND effect < 0) AS degradations FROM hm WHERE quantity = 'd_prime' GROUP BY ALL", V),
    "forest_rows": _with(
        f"{R4BOOT}, f AS (SELECT * FROM (VALUES {', '.join(f'({k}::BIGINT, {chr(39)}{n}{chr(39)}, {str(c).lower()}, {chr(39)}{g}{chr(39)})' for k, (n, c, g) in enumerate(FOREST))}) t(ord, contrast, claim, panel)) "
        f"SELECT auditor, contrast, ord, claim, panel, {PP}, n, {R('p')} AS p FROM iv_r JOIN f USING (contrast) JOIN (SELECT auditor, contrast, n FROM ef_r) USING (auditor, contrast)", "r4_verdicts"),
    "template_bootstrap": _with(
        f"{WP}, tw AS (SELECT a.auditor, a.family, a.item_id, a.p - b.p AS d FROM t a JOIN t b USING (auditor, family, item_id) WHERE a.condition = 'R1' AND b.condition = 'R0p'), {boot('t', 'tw', ['auditor', 'family'], 'item_id', 'concat(auditor, chr(47), family, $$/template$$)')} "
        f"SELECT auditor, family, {TOLD}, n FROM iv_t JOIN (SELECT auditor, family, n FROM ef_t) USING (auditor, family)", V),
    "wording_panels": _with(
        f"{WP}, pn AS (SELECT concat(a.condition, '-', b.condition) AS panel, a.auditor, a.family, a.item_id, a.p - b.p AS d FROM t a JOIN t b ON a.auditor = b.auditor AND a.family = b.family AND a.item_id = b.item_id WHERE (a.condition, b.condition) IN ({', '.join(f'({chr(39)}{h}{chr(39)}, {chr(39)}{low}{chr(39)})' for _, h, low in PANELS)})), "
        f"{boot('t', 'pn', ['panel', 'auditor', 'family'], 'item_id', 'concat_ws(chr(47), panel, auditor, family)')} SELECT panel, auditor, family, {PP} FROM iv_t", V),
    "pooled_band": _with(
        f"{PASSES}, pl AS (SELECT auditor, item_id, unnest([{{'name': 'sham', 'd': B - A}}, {', '.join(f'{{{chr(39)}name{chr(39)}: {chr(39)}{c}{chr(39)}, {chr(39)}d{chr(39)}: {c} - (A + B) / 2}}' for c in CONTROLS)}], recursive := true) FROM pw), "
        f"{boot('g', 'pl', ['auditor', 'name'], 'item_id', 'concat(auditor, chr(47), name, $$/pooled$$)')}, ro AS (SELECT auditor, name, round(effect, 9) AS effect, round(lo, 9) AS lo, round(hi, 9) AS hi FROM iv_g), bn AS (SELECT max(greatest(abs(lo), abs(hi))) AS band FROM ro WHERE name = 'sham') "
        f"SELECT auditor, name AS control, {R('effect')} AS effect, {R('lo')} AS lo, {R('hi')} AS hi, {R('band')} AS band, CASE WHEN lo > band OR hi < -band THEN 'yes' ELSE 'no' END AS beats_sham FROM ro, bn WHERE name <> 'sham'", V),
    "gate3_framing": _with(
        f"g3 AS ({inference.ORACLES['gate3_verdict']}), g0 AS ({inference.ORACLES['gate0_screen']}), x AS (SELECT g3.auditor, condition, effect, verdict, abs(framing_range) AS framing_range, abs(effect) <= abs(framing_range) AS within_framing_range FROM g3 LEFT JOIN g0 USING (auditor)) "
        "SELECT *, CASE WHEN verdict = 'MOVED' AND NOT within_framing_range THEN 'exceeds framing range: suspect' ELSE '' END AS note FROM x", V),
    "sdt_families": _with(f"{SFAM} SELECT family, auditor, condition, k, {R('p')} AS p, reject FROM hm", V),
    "prior_context_guard": _with(
        f"{SFAM}, ex AS (SELECT 3 * count(DISTINCT auditor) AS expected FROM hm), gt AS (SELECT family, count(*) AS got, string_agg(DISTINCT condition, ',' ORDER BY condition) AS present FROM hm WHERE family LIKE 'prior-context/%' GROUP BY family) "
        "SELECT family, got, expected, CASE WHEN got <> expected THEN concat('family ', family, ' has ', got, ' members, ', expected, ' are declared: tested at 0.05/', got, ', ', CASE WHEN got < expected THEN 'more lenient' ELSE 'stricter' END, ' than declared; present: ', present) END AS message FROM gt, ex", V),
    "screened_families": _with(
        f"{R4BOOT}, ts AS (SELECT auditor, contrast, round(p, 9) AS p, CASE WHEN contrast IN ({_quoted(CLAIMS)}) THEN 'r4-claims' WHEN contrast IN ({_quoted(FACTORIAL)}) THEN 'r4-factorial' END AS family FROM iv_r WHERE auditor NOT IN ({_quoted(SCREENED)})), tf AS (SELECT * FROM ts WHERE family IS NOT NULL), {_holm('tf', 'family', 'concat_ws(chr(47), auditor, contrast)')} "
        f"SELECT family, auditor, contrast, k, {R('p')} AS p, reject FROM hm", "r4_verdicts"),
    "rung_bootstrap_by_ids": _with(
        f"{inference.DIFF}, du AS (SELECT *, CASE WHEN condition IN ('R2', 'R3') THEN concat('e', episode_id) ELSE concat('i', item_id) END AS unit FROM df), {boot('a', 'du', CELL, 'unit', 'concat(' + inference.S2 + ', $$/ids$$)')} "
        f"SELECT auditor, condition, {TOLD}, n, n_clusters, condition IN ('R2', 'R3') AS clustered FROM iv_a JOIN (SELECT auditor, condition, n, n_clusters FROM ef_a) USING (auditor, condition)", V),
    "r4_item_only": _with(
        f"{R4_ITEM}, {R4_LONG}, fl AS (SELECT * FROM r4_long WHERE contrast IN ({_quoted(FACTORIAL)})), {boot('i', 'fl', ['auditor', 'contrast'], 'item_id', 'concat_ws(chr(47), auditor, contrast, $$item_id$$)')}, {boot('e', 'fl', ['auditor', 'contrast'], 'episode_id', 'concat_ws(chr(47), auditor, contrast, $$episode_id$$)')} "
        + " UNION ALL ".join(f"SELECT auditor, contrast, {R('effect')} AS effect, {R('lo')} AS lo, {R('hi')} AS hi, {R('p')} AS p, '{u}' AS unit FROM iv_{t}" for t, u in (("i", "item_id"), ("e", "episode_id"))), "r4_verdicts"),
}
