"""Rates over a stream of verdict events (an extension: late events up to a watermark count)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_rates(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Report and parse rates by auditor, condition and window of event time `ts`."""
    w = F.window("ts", window)
    out = events.withWatermark("ts", late).groupBy(w, "auditor", "condition").agg(
        F.avg(F.when(F.col("parsed"), F.col("flag").cast("double"))).alias("report_rate"), F.avg(F.col("parsed").cast("double")).alias("parse_ok_rate"), F.count(F.lit(1)).alias("n"),
    )
    return out.select(F.col("window.start").alias("window_start"), "auditor", "condition", "report_rate", "parse_ok_rate", "n")
