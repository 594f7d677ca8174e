"""Rates over per-sample verdicts: report probabilities, false alarms, localisation, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictspark.functions.stats import probit_sql, smoothed_rate_sql


def item_probabilities(verdicts: DataFrame, keys: list[str], item: str = "item_id", flag: str = "flag", parsed: str | None = "parsed") -> DataFrame:
    """p: the share of an item's parsed samples that report an error; null if none parsed."""
    reported = F.col(flag).cast("double")
    usable = F.when(F.col(parsed), reported) if parsed else reported
    return verdicts.groupBy(*keys, item).agg(F.avg(usable).alias("p"), F.count(usable).alias("n_parsed"), F.count(F.lit(1)).alias("n_samples"))


def instability(p: Column) -> Column:
    """2 min(p, 1 - p), null where p is null."""
    return 2 * F.least(p, 1 - p)


def rate_summary(probabilities: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of item means (far), instability n1, parse rate and items without a parsed sample."""
    return probabilities.groupBy(*keys).agg(
        F.avg("p").alias("far"),
        F.avg(instability(F.col("p"))).alias("n1"),
        F.coalesce(F.sum("n_parsed") / F.sum("n_samples"), F.lit(0.0)).alias("parse_ok_rate"),
        F.count_if(F.col("p").isNull()).alias("unparsed_items"),
        F.count(F.lit(1)).alias("n_items"),
    )


def modal_steps(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Each item's most frequent reported step; of equals, the one first seen."""
    counts = verdicts.where("parsed and step is not null").groupBy(*keys, "step").agg(F.count(F.lit(1)).alias("votes"), F.min("sample").alias("first_sample"))
    best = Window.partitionBy(*keys).orderBy(F.desc("votes"), "first_sample")
    return counts.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def localisation(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of usable reported steps that hit the first bad step (0-based gold) or miss by one at most."""
    off = F.when(F.col("parsed") & F.col("step").isNotNull(), F.abs(F.col("step") - F.col("gold_label") - 1))
    return verdicts.groupBy(*keys).agg(
        F.count(off).alias("usable"), F.avg((off == 0).cast("double")).alias("exact"), F.avg((off <= 1).cast("double")).alias("within_one")
    )


def calibration_bin(confidence: Column, bins: int = 10) -> Column:
    """The right-closed bin of a confidence, the first one for 0 and the last one for 1."""
    edges = F.array(*[F.lit(i * (1.0 / bins)) for i in range(1, bins)])
    return F.size(F.filter(edges, lambda e: e < confidence))


def expected_calibration_error(pairs: DataFrame, keys: list[str], confidence: str = "confidence", correct: str = "correct", bins: int = 10) -> DataFrame:
    """Sum over bins of weight * |mean confidence - mean correctness|; null pairs don't count."""
    usable = pairs.where(F.col(confidence).isNotNull() & F.col(correct).isNotNull()).withColumn("_bin", calibration_bin(F.col(confidence), bins))
    by_bin = usable.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.avg(confidence).alias("_c"), F.avg(correct).alias("_a"))
    return by_bin.groupBy(*keys).agg((F.sum(F.col("_n") * F.abs(F.col("_c") - F.col("_a"))) / F.sum("_n")).alias("ece"), F.sum("_n").cast("long").alias("n_pairs"))


def pair_disagreement(verdicts: DataFrame, keys: list[str], item: str = "item_id") -> DataFrame:
    """The share of items whose two passes (samples 0 and 1), both parsed, differ."""
    flag = lambda k: F.max(F.when((F.col("sample") == k) & F.col("parsed"), F.col("flag")))
    two = verdicts.where("sample < 2").groupBy(*keys, item).agg(flag(0).alias("a"), flag(1).alias("b")).where("a is not null and b is not null")
    return two.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg((F.col("a") != F.col("b")).cast("double")).alias("disagreement"))


def usage_summary(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Completion tokens a choice (mean, median, 95th percentile, maximum) and truncated choices."""
    each = F.col("completion_tokens") / F.col("n")
    return usage.groupBy(*keys).agg(
        F.avg(each).alias("mean_tokens"), F.percentile(each, F.lit(0.5)).alias("p50_tokens"), F.percentile(each, F.lit(0.95)).alias("p95_tokens"),
        F.max(each).alias("max_tokens"), F.count_if(F.col("finish_reason") == "length").alias("truncated"),
    )


def usage_by_request(usage: DataFrame, keys: list[str]) -> DataFrame:
    """The same of requests with several choices each: tokens a choice, truncated and all choices, requests."""
    each = F.when(F.col("n") > 0, F.col("completion_tokens") / F.col("n"))
    return usage.groupBy(*keys).agg(
        F.avg(each).alias("mean_tokens"), F.percentile(each, F.lit(0.5)).alias("p50_tokens"), F.percentile(each, F.lit(0.95)).alias("p95_tokens"), F.max(each).alias("max_tokens"),
        F.coalesce(F.sum("truncated"), F.lit(0)).alias("truncated"), F.coalesce(F.sum("choices"), F.lit(0)).alias("choices"), F.count(F.lit(1)).alias("requests"),
    )


def signal_detection(rates: DataFrame, hit: str = "hit", far: str = "far", n_signal: str = "n_signal", n_noise: str = "n_noise") -> DataFrame:
    """Adds d_prime, criterion and balanced_accuracy from hit and false-alarm rates."""
    z = rates.withColumn("_h", F.expr(smoothed_rate_sql(hit, n_signal))).withColumn("_f", F.expr(smoothed_rate_sql(far, n_noise)))
    z = z.withColumn("_zh", F.expr(probit_sql("_h"))).withColumn("_zf", F.expr(probit_sql("_f")))
    return z.select(
        *rates.columns, (F.col("_zh") - F.col("_zf")).alias("d_prime"), (-0.5 * (F.col("_zh") + F.col("_zf"))).alias("criterion"),
        (0.5 * (F.col(hit) + 1 - F.col(far))).alias("balanced_accuracy"),
    )
