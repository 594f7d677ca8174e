"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups of equal texts are the items. Their sizes are folded into a table of size
classes (exact below 4096 bytes, 12 leading bits above), whose length is bounded
whatever the input; the packing runs over that table, a class at a time, and each
bin is found as the tightest remaining capacity in a balanced tree. Groups then look
up the run of their class that their rank falls in. Documents never pass the driver.

Null texts count as empty (size 1) and form one group with empty ones. Repeated rows
are documents of their own in one group. Very long texts are groups like others; one above
a shard's share of the bytes has a shard of its own. An empty table gives an empty result. Only
the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictspark.llm.tables import discard, join_hot, keep, ranked, read

EXACT_BELOW = 4096


@dataclass
class _Node:
    key: tuple[int, int]
    weight: float
    left: _Node | None = None
    right: _Node | None = None


@dataclass
class CapacityTree:
    """Bins by remaining capacity in a treap: insert, remove and tightest fit in O(log n)."""

    seed: int = 7
    root: _Node | None = None
    _rng: random.Random = field(init=False)

    def __post_init__(self) -> None:
        self._rng = random.Random(self.seed)

    def _split(self, node: _Node | None, key: tuple[int, int]) -> tuple[_Node | None, _Node | None]:
        if node is None:
            return None, None
        if node.key < key:
            node.right, above = self._split(node.right, key)
            return node, above
        below, node.left = self._split(node.left, key)
        return below, node

    def _merge(self, a: _Node | None, b: _Node | None) -> _Node | None:
        if a is None or b is None:
            return a or b
        if a.weight > b.weight:
            a.right = self._merge(a.right, b)
            return a
        b.left = self._merge(a, b.left)
        return b

    def insert(self, remaining: int, bin_id: int) -> None:
        below, above = self._split(self.root, (remaining, bin_id))
        self.root = self._merge(self._merge(below, _Node((remaining, bin_id), self._rng.random())), above)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the (remaining, bin) with the least remaining >= size."""
        below, above = self._split(self.root, (size, -1))
        if above is None:
            self.root = below
            return None
        first = above
        while first.left is not None:
            first = first.left
        _, rest = self._split(above, (first.key[0], first.key[1] + 1))
        self.root = self._merge(below, rest)
        return first.key


def best_fit_decreasing(classes: list[tuple[int, int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Packs (class, size, count) rows into bins of `capacity`; runs of (class, from, to, bin).

    An item above the capacity has a bin of its own. With `bins`, None when more would
    be needed.
    """
    tree, runs, used = CapacityTree(), [], 0
    for cls, size, count in sorted(classes, key=lambda c: (-c[1], c[0])):
        at = 0
        while at < count:
            found = tree.take_tightest(size)
            if found is None:
                if bins is not None and used >= bins:
                    return None
                found = (max(capacity, size), used)
                used += 1
            fit = min(count - at, found[0] // size)
            runs.append((cls, at, at + fit, found[1]))
            at += fit
            tree.insert(found[0] - fit * size, found[1])
    return runs


def pack_into(classes: list[tuple[int, int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """The packing at the least capacity at which best fit needs at most `bins` bins."""
    if not classes:
        return []
    total = sum(s * n for _, s, n in classes)
    low = max(-(-total // bins), 1)
    high = max(low, max(s for _, s, _ in classes))
    while (found := best_fit_decreasing(classes, high, bins)) is None:
        high += max(1, high // 8)
    if (best := best_fit_decreasing(classes, low, bins)) is not None:
        return best
    best = found
    while high - low > max(1, low // 1_000_000):
        mid = (low + high) // 2
        got = best_fit_decreasing(classes, mid, bins)
        low, high, best = (low, mid, got) if got is not None else (mid, high, best)
    return best


def shard(docs: DataFrame, shards: int = 8, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Adds size, text_crc32, shard and slot to each row's id; equal texts share a shard."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.sha2(body, 256).alias("group"),
    )
    rows = keep(rows, "shard-rows")
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    low_bits = "greatest(cast(floor(log2(bytes)) as int) - 11, 0)"
    folded = F.expr(f"shiftleft(shiftright(bytes, {low_bits}), {low_bits})")
    cls = F.when(F.col("bytes") < EXACT_BELOW, F.col("bytes")).otherwise(folded)
    groups = keep(groups.withColumn("class", cls), "shard-groups")
    table = groups.groupBy("class").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    runs = pack_into([(r["class"], -(-r["bytes"] // r["n"]), r["n"]) for r in table], shards)
    runs_df = spark.createDataFrame(runs, "run_class long, run_from long, run_to long, shard int")
    placed = ranked(groups, "class", [F.col("group")])
    placed = placed.join(
        F.broadcast(runs_df),
        (F.col("class") == F.col("run_class")) & (F.col("rank") >= F.col("run_from")) & (F.col("rank") < F.col("run_to")),
    ).select("group", "shard")
    # Equal texts are one group, whatever its rows: they are joined in parts.
    out = keep(join_hot(rows, placed, "group").select("doc_id", "size", "text_crc32", "shard"), "shard-placed")
    discard(rows, groups)
    return ranked(out, "shard", [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law `bytes`."""
    out = shard(read(spark, sf_dir, "documents"), 8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
