"""Conditions from several directories, each against the baseline of its own.

A directory's place is its number in the list that was given. A condition that several
directories hold counts where it comes first; its baseline is R0 of that directory, never
another's, since the directories measured different items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = "R0"


def first_listed(rows: DataFrame, scope: list[str], place: str = "place") -> DataFrame:
    """The rows of each condition's first directory."""
    cell = [*scope, "condition"]
    first = rows.groupBy(*cell).agg(F.min(place).alias("_first"))
    return rows.join(F.broadcast(first), cell).where(F.col(place) == F.col("_first")).drop("_first")


def against_own_baseline(items: DataFrame, scope: list[str], place: str = "place") -> DataFrame:
    """Items (scope, condition, place, item_id, p) of all conditions but R0, with p0 of the same item under their directory's R0.

    Conditions whose directory has no R0 have no rows; p0 is null where only that item is missing.
    """
    base = items.where(F.col("condition") == BASE).select(*scope, place, "item_id", F.col("p").alias("p0"))
    scored = first_listed(items, scope, place).where(F.col("condition") != BASE).join(F.broadcast(base.select(*scope, place).distinct()), [*scope, place], "left_semi")
    return scored.join(base, [*scope, place, "item_id"], "left")


def require_same_items(items: DataFrame, scope: list[str], place: str = "place") -> DataFrame:
    """The items as they are; the query fails where a condition's items differ in number from its baseline's."""
    each = items.groupBy(*scope, place, "condition").agg(F.count(F.lit(1)).alias("_n"))
    base = each.where(F.col("condition") == BASE).select(*scope, place, F.col("_n").alias("_base"))
    both = each.join(base, [*scope, place], "left")
    said = F.concat_ws(" ", F.concat_ws("/", *scope, "condition"), F.lit("has"), F.col("_n"), F.lit("items, its baseline"), F.col("_base"))
    sound = both.withColumn("_ok", F.when(F.col("_n") != F.col("_base"), F.raise_error(said)).otherwise(F.lit(True))).where("_ok or _ok is null")
    return items.join(F.broadcast(sound.select(*scope, place, "condition")), [*scope, place, "condition"])
