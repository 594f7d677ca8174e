"""Step-down correction of declared families of tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holm(tests: DataFrame, family: list[str], order: Column, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Adds k, rank, threshold and reject; all members stay, ties keep `order`."""
    ranked = Window.partitionBy(*family).orderBy(p, order)
    out = tests.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy(*family))).withColumn("rank", F.row_number().over(ranked))
    out = out.withColumn("threshold", F.lit(alpha) / (F.col("k") - F.col("rank") + 1))
    return out.withColumn("reject", F.min(F.col(p) <= F.col("threshold")).over(ranked.rowsBetween(Window.unboundedPreceding, 0)))


def guard_message(got: Column, expected: Column, family: Column, present: Column, alpha: float = 0.05) -> Column:
    """Null for a family as declared, else a warning that says which way it errs."""
    way = F.when(got < expected, "more lenient").otherwise("stricter")
    text = F.concat(
        F.lit("family "), family, F.lit(" has "), got.cast("string"), F.lit(" members, "), expected.cast("string"), F.lit(" are declared: tested at "),
        F.lit(f"{alpha}/"), got.cast("string"), F.lit(", "), way, F.lit(" than declared; present: "), present,
    )
    return F.when(got != expected, text)
