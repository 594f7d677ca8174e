"""Statistics against independent computations, and metamorphic properties."""

import hashlib
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictspark.functions.stats import paired_p, probit
from verdictspark import catalog
from verdictspark.operators import multiplicity, rates, refusals, resampling, sampling, simulation, streams
from verdictspark.plans import inference, simulated


def test_probit(spark):
    ps = [1e-14, 1e-6, 0.01, 0.2, 0.5, 0.6, 0.975, 0.9995]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(probit("p")).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-12)


def test_paired_p(spark):
    got = [r[0] for r in spark.createDataFrame([(0.0,), (1.96,), (-2.5,), (None,)], "z double").select(paired_p("z")).collect()]
    assert got == pytest.approx([1.0, 0.0499958, 0.0124193, 1.0], abs=1e-6)


def test_holm(spark):
    x = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double").withColumn("family", F.lit(1))
    got = {r["name"]: (r["rank"], round(r["threshold"], 6), r["reject"]) for r in multiplicity.holm(x, ["family"], F.col("name")).collect()}
    assert got == {"a": (1, 0.016667, True), "c": (2, 0.025, False), "b": (3, 0.05, False)}


def test_rates_skip_unparsed(spark):
    x = spark.createDataFrame([("m", 1, 1, True), ("m", 1, 0, True), ("m", 2, 1, False)], "auditor string, item_id int, flag int, parsed boolean")
    p = rates.item_probabilities(x, ["auditor"])
    assert {r["item_id"]: r["p"] for r in p.collect()} == {1: 0.5, 2: None}
    s = rates.rate_summary(p, ["auditor"]).first()
    assert (s["far"], s["n1"], s["unparsed_items"]) == (0.5, 1.0, 1) and s["parse_ok_rate"] == pytest.approx(2 / 3)


def test_calibration_bins(spark):
    got = [r[0] for r in spark.createDataFrame([(0.0,), (0.1,), (0.1000001,), (0.95,), (1.0,)], "c double").select(rates.calibration_bin(F.col("c"))).collect()]
    assert got == [0, 0, 1, 9, 9]


def _diffs(spark, stream):
    rng = np.random.default_rng(3)
    rows = [(stream, int(i), int(c), float(rng.normal(0.05, 0.15))) for c in range(20) for i in range(5)]
    return spark.createDataFrame(rows, "name string, item int, cluster int, d double"), rows


def test_bootstrap_agrees_with_numpy(spark):
    x, rows = _diffs(spark, "a")
    got = resampling.bootstrap(x, ["name"], "cluster", "d", 2000, F.col("name")).first()
    exact = simulation.exact_bootstrap(x, ["name"], "cluster", "d", 20000).first()
    assert got["effect"] == pytest.approx(np.mean([r[3] for r in rows]))
    assert (got["lo"], got["hi"]) == pytest.approx((exact["lo"], exact["hi"]), abs=0.01)
    assert got["n"] == 100 and got["n_clusters"] == 20


def test_other_contrasts_do_not_move_a_result(spark):
    x, _ = _diffs(spark, "a")
    y, _ = _diffs(spark, "b")
    alone = resampling.bootstrap(x, ["name"], "cluster", "d", 300, F.col("name")).first()
    beside = resampling.bootstrap(x.unionByName(y).repartition(3), ["name"], "cluster", "d", 300, F.col("name")).where("name = 'a'").first()
    assert alone.asDict() == pytest.approx(beside.asDict())


def test_degenerate_intervals_keep_the_floor(spark):
    x = spark.createDataFrame([("a", i, 0.0) for i in range(5)], "name string, item int, d double")
    got = resampling.bootstrap(x, ["name"], "item", "d", 100, F.col("name")).first()
    assert got["degenerate"] and got["p"] == pytest.approx(0.01)


def test_round_robin_and_allocation(spark):
    pool = spark.createDataFrame([(i, "abc"[i % 3 if i < 9 else 0], i % 4 == 0) for i in range(30)], "item_id int, split string, ok boolean")
    arms = sampling.allocate(pool, [("x", 6, None), ("y", 3, F.col("ok"))], "s").collect()
    assert len({r["item_id"] for r in arms}) == 9
    # y is restricted, so it takes first: one of each split that has eligible rows, cycling; x cycles over what is left.
    y = sorted(r["split"] for r in arms if r["arm"] == "y")
    left = {c: n - y.count(c) for c, n in (("a", 24), ("b", 3), ("c", 3))}
    assert y == ["a", "b", "c"] and min(left.values()) >= 2
    assert sorted(r["split"] for r in arms if r["arm"] == "x") == ["a", "a", "b", "b", "c", "c"]
    for short in (sampling.allocate(pool, [("z", 31, None)], "s"), sampling.allocate(pool.limit(0), [("z", 1, None)], "s"), sampling.allocate(pool, [("x", 25, None), ("y", 6, None)], "s")):
        with pytest.raises(Exception, match="arm . needs"):
            short.collect()


def test_global_rank(spark):
    x = spark.createDataFrame([(int(v),) for v in np.random.default_rng(1).permutation(500) * 3], "item_id int")
    got = sorted((r["item_id"], r["r"]) for r in sampling.global_rank(x, "item_id", "r", 7).collect())
    assert got == [(3 * i, i) for i in range(500)]


def test_simulation():
    rng = np.random.default_rng(0)
    p = simulation.propensities(rng, 0.15, 8, 5000)
    for mechanism in ("additive", "logit"):
        assert simulation.shifted(p, simulation.solve_shift(p, 0.03, mechanism), mechanism).mean() == pytest.approx(p.mean() + 0.03, abs=1e-6)
    with pytest.raises(ValueError):
        simulation.solve_shift(p, 0.99, "logit")
    assert not simulation.normal_rejects(np.zeros(10))
    d = [rng.normal(0, 1, 400) for _ in range(100)]
    assert np.mean([simulation.bootstrap_rejects(x, rng) == bool(simulation.normal_rejects(x)) for x in d]) >= 0.95


def test_family_wise_rate(spark):
    r = simulation.family_false_pass(spark, reps=300).first()
    assert r["holm"] <= 0.08 < r["none"]


def test_registered_counts_are_those_of_the_reference(spark):
    """20,000 replicates in queries and twins, 2,000 families, 1,000 studies a cell over three numbers of samples."""
    assert inference.REPS == 20_000 and all("range(20000)" in catalog.ORACLES[n] for n in ("rung_bootstrap", "sdt_bootstrap", "n2_band", "gate0_screen"))
    assert {(c[3], c[4], c[5]) for c in simulated.SWEEP} == {(4, None, 1000), (8, None, 1000), (16, None, 1000)} and len(simulated.SWEEP) == 36
    assert simulated.family_false_pass(spark, "").first()["families"] == 2000


def test_least_items(spark):
    assert simulation.fewest(lambda n: n / 1000, 0.8, 20_000) == 800 and simulation.fewest(lambda n: 0.0, 0.8, 20_000) is None
    cells = [(0.05, 0.15, "logit", 8, None, 300), (0.0, 0.15, "logit", 8, 400, 1000), (0.03, 0.30, "additive", 1, None, 20)]
    found, null, beyond = simulation.least_items(spark, cells, most=400).orderBy("samples", "delta").collect()[::-1]
    assert 50 <= found["n_items"] < 400 and found["power"] >= 0.8
    assert null["n_items"] == 400 and 0.02 < null["power"] < 0.09
    assert beyond["n_items"] is None and beyond["power"] is None


def test_fingerprints_read_members_row_by_row(spark):
    """Values of a plain hash in order of pos, from many partitions and batches, with no array of a pool's text."""
    rows = [(c, p, f"e{p}", None if p % 7 == 0 else f"é{p * 31 % 101}") for c in ("a", "b", None) for p in range(300 if c == "a" else 40)]
    pool = spark.createDataFrame(rows, "cell string, pos int, item string, text string").repartition(9, "text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        found = sampling.fingerprint(pool, ["cell"], "pos", ["item", "text"])
        got = {r["cell"]: (r["n"], r["fingerprint"]) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = lambda c: "".join(i + (t or "") for k, _, i, t in sorted((r for r in rows if r[0] == c), key=lambda r: r[1]))
    assert got == {c: (300 if c == "a" else 40, hashlib.sha256(plain(c).encode()).hexdigest()[:16]) for c in ("a", "b", None)}
    assert "collect_list" not in found._jdf.queryExecution().toString()


def _rates(n, seed=5, lift=0.04):
    """Differences of rates of eight samples."""
    rng = np.random.default_rng(seed)
    base = rng.beta(2, 6, n)
    return (rng.binomial(8, np.clip(base + lift, 0, 1)) - rng.binomial(8, base)) / 8


def test_histogram_draws_have_the_law_of_item_draws(spark, monkeypatch):
    d = _rates(1200)
    x = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(d)], "name string, item int, d double")
    table = resampling.clusters(x, ["name"], "item", ["d"])
    one = np.array([r["d"] for r in resampling.replicates(table, ["name"], ["d"], 6000, F.col("name")).collect()])
    monkeypatch.setattr(resampling, "MOST_DRAWN", 1000)
    many = resampling.replicates(table, ["name"], ["d"], 6000, F.col("name"))
    rows = many.collect()
    assert sorted(r["rep"] for r in rows) == list(range(6000))
    assert {(r["rep"], r["d"]) for r in rows} == {(r["rep"], r["d"]) for r in resampling.replicates(table.repartition(7), ["name"], ["d"], 6000, F.col("name")).collect()}
    two = np.array([r["d"] for r in rows])
    error = d.std() / np.sqrt(len(d))
    for drawn in (one, two):
        assert abs(drawn.mean() - d.mean()) < 5 * error / np.sqrt(6000) and drawn.std() == pytest.approx(error, rel=0.04)
    assert np.quantile(two, [0.025, 0.5, 0.975]) == pytest.approx(np.quantile(one, [0.025, 0.5, 0.975]), abs=0.12 * error)
    # Items are neither drawn one by one nor numbered.
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and "MapInArrow" in plan


def test_histogram_draws_cover_the_true_mean():
    rng = np.random.default_rng(11)
    inside = 0
    for study in range(400):
        values, counts = np.unique(_rates(300, seed=rng.integers(1 << 31), lift=0.0), return_counts=True)
        means = resampling.multinomial_means(np.stack([values, np.ones(len(values))], 1), counts, 500, study, 0)[:, 0]
        lo, hi = np.quantile(means, [0.025, 0.975])
        inside += lo <= 0 <= hi
    assert 0.92 <= inside / 400 <= 0.975


def test_keys_of_both_kinds_and_values_without_rows(spark, monkeypatch):
    monkeypatch.setattr(resampling, "MOST_DRAWN", 50)
    rows = [("small", i, 0.5, None) for i in range(20)] + [("large", i, float(i % 2), 1.0 if i == 0 else None) for i in range(80)] + [("one", 0, 1.0, 1.0)]
    table = resampling.clusters(spark.createDataFrame(rows, "name string, item int, d double, e double"), ["name"], "item", ["d", "e"])
    got = resampling.replicates(table, ["name"], ["d", "e"], 700, F.col("name")).collect()
    of = lambda name, v: [r[v] for r in got if r["name"] == name]
    assert {name: len(of(name, "d")) for name in ("small", "large", "one")} == {"small": 700, "large": 700, "one": 700}
    assert set(of("small", "d")) == {0.5} and set(of("small", "e")) == {None} and set(of("one", "e")) == {1.0}
    # The one row of e is missing from a replicate with probability (1 - 1/80)^80.
    assert sum(e is None for e in of("large", "e")) / 700 == pytest.approx(0.366, abs=0.07)


def test_two_hundred_thousand_items(spark):
    d = _rates(200_000)
    values, counts = np.unique(d, return_counts=True)
    x = spark.createDataFrame([(float(v), int(c)) for v, c in zip(values, counts)], "d double, c int").selectExpr("'a' AS name", "d", "explode(sequence(1, c)) AS one").withColumn("item", F.monotonically_increasing_id())
    got = resampling.bootstrap(x, ["name"], "item", "d", 20_000, F.col("name")).first()
    assert got["n"] == got["n_clusters"] == 200_000 and got["effect"] == pytest.approx(d.mean())
    assert (got["hi"] - got["lo"]) / 2 == pytest.approx(1.96 * d.std() / np.sqrt(200_000), rel=0.03)


def test_streams_give_numpys_values_in_the_records_order(spark):
    rng = np.random.default_rng(2)
    rows = [(name, i, int(i % 7), float(rng.normal(0.02, 0.1)) if i != 5 else None) for name in ("a", "b") for i in range(40)]
    x = spark.createDataFrame(rows, "name string, item int, cluster int, d double").repartition(5)
    found = streams.Streams(9)
    got = {(r["name"], r["unit"]): r for r in found.intervals(x, ["name"], "d", "item", "cluster", 3000).collect()}
    for name in ("a", "b"):
        own = [r for r in rows if r[0] == name and r[3] is not None]
        d, c = np.array([r[3] for r in own]), np.array([r[2] for r in own])
        draw = np.random.default_rng([9, ord(name)])
        items = d[draw.integers(0, len(d), size=(3000, len(d)))].mean(axis=1)
        members = [np.flatnonzero(c == k) for k in range(7)]
        episodes = np.array([d[np.concatenate([members[k] for k in draw.integers(0, 7, size=7)])].mean() for _ in range(3000)])
        for unit, means in (("item", items), ("cluster", episodes)):
            r = got[name, unit]
            assert (r["lo"], r["hi"]) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=1e-12)
            assert r["p"] == pytest.approx(max(2 * min((means <= 0).mean(), 1 - (means <= 0).mean()), 1 / 3000)) and r["n"] == 39
    with pytest.raises(ValueError, match=r"second time: \['a', 'b'\]"):
        found.intervals(x, ["name"], "d", "item")
    assert streams.Streams(9).intervals(x, ["name"], "d", "item", None, 10).count() == 2


def test_streams_do_not_depend_on_how_draws_are_cut(monkeypatch):
    d = np.random.default_rng(1).normal(size=33)
    whole = streams.item_means(d, streams.generator(1, "x"), 100)
    monkeypatch.setattr(streams, "HELD_DRAWS", 99)
    assert (streams.item_means(d, streams.generator(1, "x"), 100) == whole).all()


def test_refusals_cost_no_job(spark):
    rows = spark.createDataFrame([(i, f"i{i}") for i in range(6)], "k int, item_id string")
    seen, watch = refusals.watched(rows, F.col("k") > 3, F.col("item_id"), "too large")
    assert seen.count() == 6
    with pytest.raises(ValueError, match="too large: 2 of 6 rows, as i4, i5"):
        watch.settle()
    seen, watch = refusals.watched(rows, F.col("k") > 9, F.col("item_id"), "too large")
    seen.collect()
    watch.settle()
    assert refusals.refuse_unmatched(rows, rows, "item_id", "x").count() == 6
    assert refusals.refuse_matched(rows, rows.where("k > 8"), "item_id", "x").count() == 6
    for bad, said in ((refusals.refuse_unmatched(rows, rows.where("k <> 2"), "item_id", "steps"), "steps: none for i2"), (refusals.refuse_matched(rows, rows.where("k = 3"), "item_id", "seen before"), "seen before: i3")):
        with pytest.raises(Exception, match=said):
            bad.count()


def test_rungs_cluster_where_the_data_has_ids(spark):
    rows = [("R1", i, None) for i in range(4)] + [("R2", i, i % 2) for i in range(4)]
    x = spark.createDataFrame(rows, "condition string, item_id int, episode_id int")
    got = {(r["condition"], r["clustered"], r["unit"]) for r in resampling.unit_by_ids(x, ["condition"]).collect()}
    assert got == {("R1", False, f"i{i}") for i in range(4)} | {("R2", True, "e0"), ("R2", True, "e1")}
    mixed = x.withColumn("episode_id", F.when(F.col("item_id") > 0, F.col("episode_id")))
    with pytest.raises(Exception, match="only some items have an episode: R2"):
        resampling.unit_by_ids(mixed, ["condition"]).collect()
