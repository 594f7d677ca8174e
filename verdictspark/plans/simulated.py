"""Simulation queries; random by nature, so without SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdictspark.functions.stats import rounded
from verdictspark.operators import simulation, streams
from verdictspark.plans.rates import CELL

#: The reference's sweep: the fewest items for two effects, three baselines, two mechanisms and three numbers of samples.
SWEEP = [(d, b, m, n, None, 1000) for d in (0.03, 0.05) for b in (0.05, 0.15, 0.30) for m in ("logit", "additive") for n in (4, 8, 16)]
#: Its null calibration: no effect, two fixed sizes.
NULL = [(0.0, 0.15, "logit", n, items, 4000) for n in (4, 8, 16) for items in (400, 1200)]


def power_sim(spark: SparkSession, sf: str) -> DataFrame:
    """The fewest items with a power of 0.8, null above 20,000; rows of no effect have the false-positive rate."""
    out = simulation.least_items(spark, [*SWEEP, *NULL])
    return out.select("delta", "baseline", "mechanism", "samples", "n_items", rounded("power").alias("power"), "studies")


def family_false_pass(spark: SparkSession, sf: str) -> DataFrame:
    out = simulation.family_false_pass(spark, reps=2000)
    return out.select(rounded("none").alias("none"), rounded("holm").alias("holm"), "families")


def exact_rng_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    from verdictspark.plans.inference import STATS, rung_differences

    out = simulation.exact_bootstrap(rung_differences(spark, sf), CELL, "episode_id", "d")
    return out.select(*CELL, *[rounded(c).alias(c) for c in STATS], "n", "n_clusters")


def exact_rng_r4(spark: SparkSession, sf: str) -> DataFrame:
    """The factorial's contrasts: each one's generator serves the items' interval, then that of the episodes."""
    from verdictspark.plans.rates import contrast_items, r4_pivot

    d = contrast_items(r4_pivot(spark, sf))
    out = streams.Streams().intervals(d, ["auditor", "contrast"], "d", "item_id", "episode_id")
    return out.select("auditor", "contrast", "unit", *[rounded(c).alias(c) for c in ("effect", "lo", "hi", "p", "p_centred")], "n", "n_clusters")


QUERIES = {f.__name__: f for f in (power_sim, family_false_pass, exact_rng_bootstrap, exact_rng_r4)}
ORACLES: dict[str, str] = {}
