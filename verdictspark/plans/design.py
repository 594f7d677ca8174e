"""Allocation, sampling, pairing and episode-pool queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdictspark.functions.stats import rounded
from verdictspark.operators import sampling
from verdictspark.plans.rates import _with
from verdictspark.sources.fixtures import view

SEED = "7"
ARMS = (("main", 40), ("injected", 16), ("spare", 12))


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "alloc_pool")


def allocate_arms(spark: SparkSession, sf: str) -> DataFrame:
    arms = [(n, k, F.col("eligible") if n == "injected" else None) for n, k in ARMS]
    return sampling.allocate(_pool(spark, sf), arms, SEED).select("arm", "item_id", "split")


def arm_disjointness(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the arms are disjoint and complete."""
    arms = allocate_arms(spark, sf)
    return arms.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("item_id").alias("items")).select("rows", "items", (F.col("rows") == F.col("items")).alias("disjoint"), (F.col("rows") == sum(n for _, n in ARMS)).alias("complete"))


def proportional_subset(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.proportional(_pool(spark, sf), 0.125, SEED).select("item_id", "split", F.col("rn").cast("long").alias("rn"))


def proportional_arm(spark: SparkSession, sf: str) -> DataFrame:
    pool = _pool(spark, sf)
    return sampling.proportional_to(pool.where("label = 0"), pool.where("label = -1"), 30, SEED).select("item_id", "split", F.col("rn").cast("long").alias("rn"))


def balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    out = sampling.by_stratum(_pool(spark, sf).where("label = -1"), "split", SEED)
    return out.where(F.col("rn") <= 50 // 4).select("item_id", "split", F.col("rn").cast("long").alias("rn"))


def audit_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A share of each stratum, one at least, the first 25 of all."""
    share = sampling.proportional(_pool(spark, sf).where("eligible"), 0.02, SEED, least=1)
    return sampling.round_robin(share, 25, "split").select("item_id", "split", F.col("turn").cast("long").alias("turn"))


def natural_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Round robin over sources in order of first appearance, file order within, exclusions left out."""
    pool = _pool(spark, sf).where("label = 0")
    excluded = pool.where("item_id % 7 = 0").select("item_id")
    left = pool.join(excluded, "item_id", "left_anti")
    first = left.groupBy("split").agg(F.min("item_id").alias("first_pos"))
    ranked = left.join(F.broadcast(first), "split")
    ranked = ranked.withColumn("rn", F.row_number().over(Window.partitionBy("split").orderBy("item_id")))
    return sampling.round_robin(ranked, 20, "first_pos").select("item_id", "split", F.col("turn").cast("long").alias("turn"))


def early_late_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """All early candidates before any late one, up to a limit; the id names the arm."""
    pairs = _pool(spark, sf).where("eligible").select("item_id")
    both = pairs.select("item_id", F.lit("early").alias("arm"), F.lit(0).alias("o")).unionByName(pairs.select("item_id", F.lit("late").alias("arm"), F.lit(1).alias("o")))
    out = both.orderBy("o", "item_id").limit(700)
    return out.select(F.concat_ws("::", F.col("item_id").cast("string"), "arm").alias("candidate"))


def _episodes(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "episodes")


def usable_episodes(spark: SparkSession, sf: str, n: int = 10) -> DataFrame:
    """The first n episodes with an audit and a repair, renumbered in order."""
    ok = _episodes(spark, sf).where("audit is not null and repair is not null")
    ok = ok.orderBy("pos").limit(n)
    return ok.withColumn("pos", (F.row_number().over(Window.orderBy("pos")) - 1).cast("long"))


def episode_pairing(spark: SparkSession, sf: str) -> DataFrame:
    """Targets and the episodes that they are read behind; a target is never its own episode."""
    targets = _pool(spark, sf).where("label = -1").select("item_id")
    pool = usable_episodes(spark, sf).select("pos", F.col("item_id").alias("episode_id"))
    return sampling.cyclic_pairs(targets, pool, 10).select("item_id", "pos", "episode_id")


def pairing_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct episodes and targets for each."""
    x = episode_pairing(spark, sf).agg(F.count(F.lit(1)).alias("targets"), F.countDistinct("episode_id").alias("episodes"))
    return x.select("targets", "episodes", rounded(F.try_divide("targets", "episodes")).alias("targets_per_episode"))


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """Pools of five cells: one of them is built from another pool."""
    ok = _episodes(spark, sf).where("audit is not null and repair is not null")
    cells = spark.createDataFrame([("AS", 0), ("AO", 0), ("AF", 1), ("AX", 2), ("AXN", 2)], "cell string, skip int")
    return cells.join(ok, F.col("pos") % 3 >= F.col("skip"))


def pool_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.fingerprint(_cells(spark, sf), ["cell"], "pos", ["item_id", "audit", "repair"])


def fingerprint_check(spark: SparkSession, sf: str) -> DataFrame:
    """One fingerprint at most in each group of cells that contrasts join."""
    group = F.when(F.col("cell").isin("AX", "AXN"), "incorrect").otherwise("ordinary")
    x = pool_fingerprint(spark, sf).groupBy(group.alias("pool")).agg(F.countDistinct("fingerprint").alias("prints"), F.array_join(F.array_sort(F.collect_set("cell")), ",").alias("cells"))
    return x.select("pool", "prints", "cells", (F.col("prints") <= 1).alias("consistent"))


def episode_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes without a usable audit or repair, which a contrast must refuse."""
    e = _episodes(spark, sf)
    have = e.where("audit is not null and repair is not null").select("item_id")
    return e.join(have, "item_id", "left_anti").select("item_id", F.when(F.col("audit").isNull(), "no audit").otherwise("no repair").alias("reason"))


def length_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Least, upper median and greatest length of repairs."""
    by_length = _episodes(spark, sf).where("repair is not null").groupBy(F.length("repair").cast("long").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    # A row for each distinct length: the running count finds the element at half of all, from 0.
    upto = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = by_length.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("x")))
    return ranked.agg(F.min("x").alias("least"), middle.alias("upper_median"), F.max("x").alias("greatest"))


def missing_items(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted ids that the pool lacks."""
    wanted = _pool(spark, sf).where("item_id % 10 = 0").select((F.col("item_id") * 2).alias("item_id"))
    return wanted.join(_pool(spark, sf).select("item_id"), "item_id", "left_anti")


def arm_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Traces that qualify for the arms: right and long enough, wrong, or wrong and long enough."""
    long, wrong = F.col("n_steps") >= 4, F.col("label") != -1
    x = view(spark, sf, "traces").groupBy("split")
    return x.agg(F.count(F.lit(1)).alias("traces"), F.count_if(~wrong & long).alias("clean"), F.count_if(wrong).alias("faulty"), F.count_if(wrong & long).alias("faulty_long"))


def stratum_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _pool(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if("eligible").alias("eligible"), F.count_if(F.col("label") == -1).alias("clean"))


QUERIES = {
    f.__name__: f
    for f in (
        allocate_arms, arm_disjointness, proportional_subset, proportional_arm, balanced_sample, audit_sample, natural_candidates, early_late_candidates,
        episode_pairing, pairing_counts, pool_fingerprint, fingerprint_check, episode_coverage, length_summary, missing_items, arm_filters, stratum_counts,
    )
}


def _order(arm: str = "") -> str:
    seed = f"{SEED}/{arm}" if arm else SEED
    return f"md5(concat('{seed}:', item_id)), item_id"


def _take(name: str, source: str, n: int, where: str) -> str:
    return (
        f"{name}_r AS (SELECT item_id, split, row_number() OVER (PARTITION BY split ORDER BY {_order(name)}) AS rn FROM {source} WHERE {where}), "
        f"{name} AS (SELECT '{name}' AS arm, item_id, split FROM {name}_r QUALIFY row_number() OVER (ORDER BY rn, split) <= {n})"
    )


ALLOCATED = ", ".join((
    _take("injected", "alloc_pool", 16, "eligible"),
    _take("main", "alloc_pool", 40, "item_id NOT IN (SELECT item_id FROM injected)"),
    _take("spare", "alloc_pool", 12, "item_id NOT IN (SELECT item_id FROM injected) AND item_id NOT IN (SELECT item_id FROM main)"),
    "allocated AS (SELECT * FROM injected UNION ALL SELECT * FROM main UNION ALL SELECT * FROM spare)",
))
P, E = "alloc_pool", "episodes"
RANKED = f"r AS (SELECT item_id, split, row_number() OVER (PARTITION BY split ORDER BY {_order()}) AS rn, count(*) OVER (PARTITION BY split) AS c FROM alloc_pool"
PAIRS = (
    "ok AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, item_id AS episode_id FROM episodes WHERE audit IS NOT NULL AND repair IS NOT NULL ORDER BY pos LIMIT 10), "
    "pairs AS (SELECT t.item_id, ok.pos, ok.episode_id FROM (SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1) % 10 AS i FROM alloc_pool WHERE label = -1) t JOIN ok ON ok.pos = t.i)"
)
PRINTS = (
    "cl AS (SELECT * FROM (VALUES ('AS', 0), ('AO', 0), ('AF', 1), ('AX', 2), ('AXN', 2)) t(cell, skip)), "
    "fp AS (SELECT cell, count(*) AS n, substr(sha256(string_agg(concat(item_id, audit, repair), '' ORDER BY pos)), 1, 16) AS fingerprint FROM cl JOIN episodes ON pos % 3 >= skip WHERE audit IS NOT NULL AND repair IS NOT NULL GROUP BY cell)"
)
ORACLES = {
    "allocate_arms": _with(f"{ALLOCATED} SELECT arm, item_id, split FROM allocated", P),
    "arm_disjointness": _with(f"{ALLOCATED} SELECT count(*) AS rows, count(DISTINCT item_id) AS items, count(*) = count(DISTINCT item_id) AS disjoint, count(*) = {sum(n for _, n in ARMS)} AS complete FROM allocated", P),
    "proportional_subset": _with(f"{RANKED}) SELECT item_id, split, rn FROM r WHERE rn <= round_even(c * 0.125, 0)", P),
    "proportional_arm": _with(f"{RANKED} WHERE label = 0), m AS (SELECT split, count(*) AS c, sum(count(*)) OVER () AS t FROM alloc_pool WHERE label = -1 GROUP BY split) SELECT item_id, r.split, rn FROM r JOIN m ON m.split = r.split WHERE rn <= round_even(30::DOUBLE * m.c / m.t, 0)", P),
    "balanced_sample": _with(f"{RANKED} WHERE label = -1) SELECT item_id, split, rn FROM r WHERE rn <= 12", P),
    "audit_sample": _with(f"{RANKED} WHERE eligible), k AS (SELECT * FROM r WHERE rn <= greatest(1, round_even(c * 0.02, 0))) SELECT item_id, split, row_number() OVER (ORDER BY rn, split) AS turn FROM k QUALIFY turn <= 25", P),
    "natural_candidates": _with("n AS (SELECT item_id, split, row_number() OVER (PARTITION BY split ORDER BY item_id) AS rn, min(item_id) OVER (PARTITION BY split) AS f FROM alloc_pool WHERE label = 0 AND item_id % 7 <> 0) SELECT item_id, split, row_number() OVER (ORDER BY rn, f) AS turn FROM n QUALIFY turn <= 20", P),
    "early_late_candidates": _with("c AS (SELECT item_id, 'early' AS arm, 0 AS o FROM alloc_pool WHERE eligible UNION ALL SELECT item_id, 'late', 1 FROM alloc_pool WHERE eligible) SELECT concat(item_id, '::', arm) AS candidate FROM c ORDER BY o, item_id LIMIT 700", P),
    "episode_pairing": _with(f"{PAIRS} SELECT * FROM pairs", P, E),
    "pairing_counts": _with(f"{PAIRS} SELECT count(*) AS targets, count(DISTINCT episode_id) AS episodes, round(count(*) / nullif(count(DISTINCT episode_id), 0), 6) + 0.0 AS targets_per_episode FROM pairs", P, E),
    "pool_fingerprint": _with(f"{PRINTS} SELECT * FROM fp", E),
    "fingerprint_check": _with(f"{PRINTS} SELECT CASE WHEN cell IN ('AX', 'AXN') THEN 'incorrect' ELSE 'ordinary' END AS pool, count(DISTINCT fingerprint) AS prints, string_agg(cell, ',' ORDER BY cell) AS cells, count(DISTINCT fingerprint) <= 1 AS consistent FROM fp GROUP BY 1", E),
    "episode_coverage": _with("SELECT item_id, CASE WHEN audit IS NULL THEN 'no audit' ELSE 'no repair' END AS reason FROM episodes WHERE audit IS NULL OR repair IS NULL", E),
    "length_summary": _with("x AS (SELECT list_sort(list(length(repair))) AS x FROM episodes WHERE repair IS NOT NULL) SELECT x[1] AS least, x[len(x) // 2 + 1] AS upper_median, x[-1] AS greatest FROM x", E),
    "missing_items": _with("SELECT item_id * 2 AS item_id FROM alloc_pool a WHERE item_id % 10 = 0 AND NOT EXISTS (SELECT 1 FROM alloc_pool b WHERE b.item_id = a.item_id * 2)", P),
    "arm_filters": _with("SELECT split, count(*) AS traces, count(*) FILTER (label = -1 AND n_steps >= 4) AS clean, count(*) FILTER (label <> -1) AS faulty, count(*) FILTER (label <> -1 AND n_steps >= 4) AS faulty_long FROM traces GROUP BY split", "traces"),
    "stratum_counts": _with("SELECT split, count(*) AS n, count(*) FILTER (eligible) AS eligible, count(*) FILTER (label = -1) AS clean FROM alloc_pool GROUP BY split", P),
}
