"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictspark.llm.tables import discard, join_hot, keep


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of edges (a, b), root being the smallest id of its component.

    Each step is a grouped minimum, combined before the shuffle, and a join that spreads
    the edges of large nodes; the edges are written between the steps. Loops and repeated edges do no harm; no edges, no rows.
    """
    edges = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        up = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = edges.unionByName(up).groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = join_hot(up, least, "a", before[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = keep(large, "edges")
        discard(edges)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_hot(large, down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = keep(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        discard(large)
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots).distinct()
