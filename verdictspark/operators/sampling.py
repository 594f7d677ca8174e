"""Deterministic sampling, allocation and pairing by hashed order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hashed_order(seed: str, item: str = "item_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(item).cast("string")).cast("binary"))


#: Leading hexadecimal digits of the hashed order that cut a stratum into parts of about equal size.
PART_DIGITS = 3


def by_stratum(pool: DataFrame, split: str, seed: str, item: str = "item_id", name: str = "rn", most: int | None = None) -> DataFrame:
    """Adds each item's place in its stratum's hashed order, from 1; with `most` only items that can be among so many.

    The hash cuts a stratum into parts that are ranked apart and add the counts of the
    parts before them, so that no task orders a whole stratum.
    """
    h = hashed_order(seed, item)
    parted = pool.withColumn("_part", F.substring(h, 1, PART_DIGITS))
    counts = parted.groupBy(split, "_part").agg(F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy(split).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(split).alias("_split"), F.col("_part").alias("_at"), F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"))
    if most is not None:
        counts = counts.where(F.col("_below") < most)
    joined = parted.join(counts, parted[split].eqNullSafe(counts["_split"]) & (parted["_part"] == counts["_at"]))
    own = F.row_number().over(Window.partitionBy(split, "_part").orderBy(h, item))
    return joined.withColumn(name, (F.col("_below") + own).cast("int")).drop("_part", "_split", "_at", "_below")


def round_robin(ranked: DataFrame, n: int, stratum_order: str) -> DataFrame:
    """The first n of items that strata give in turn: by place in the stratum, then by stratum.

    Only the first n of each stratum can be taken, so that at most n rows a stratum reach
    the one ordering of the whole.
    """
    turn = Window.orderBy("rn", stratum_order)
    return ranked.where(F.col("rn") <= n).withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= n)


def allocate(pool: DataFrame, arms: list[tuple[str, int, Column | None]], seed: str, split: str = "split", item: str = "item_id") -> DataFrame:
    """Disjoint arms (name, size, restriction): restricted ones first, smaller pools first. The query fails where an arm's pool is short.

    Every arm has a hashed order of its own. An item that it takes has at most as many items
    before it in its stratum as this arm and those before it take, so one pass over the pool
    leaves for each arm and stratum that many candidates at most; their number depends on the
    arms' sizes alone, and one task settles who takes what.
    """
    sizes = pool.agg(*[F.count_if(only) if only is not None else F.lit(0) for _, _, only in arms]).first()
    order = sorted(range(len(arms)), key=lambda i: (arms[i][2] is None, sizes[i], i))
    offers, reach = [], 0
    for place, i in enumerate(order):
        name, n, only = arms[i]
        reach += n
        offers.append(F.struct(F.lit(place).alias("place"), F.lit(name).alias("arm"), F.lit(reach).alias("reach"), (F.lit(True) if only is None else F.coalesce(only, F.lit(False))).alias("open")))
    rows = pool.withColumn("_o", F.explode(F.filter(F.array(*offers), lambda o: o["open"]))).select(F.col("_o.place").alias("place"), F.col("_o.arm").alias("arm"), F.col("_o.reach").alias("reach"), item, split)
    rows = rows.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}/"), "arm", F.lit(":"), F.col(item).cast("string")).cast("binary"))).withColumn("_part", F.substring("_h", 1, PART_DIGITS))
    counts = rows.groupBy("place", "reach", F.col(split).alias("_split"), "_part").agg(F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy("place", "_split").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    near = counts.withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0))).where("_below < reach").select(F.col("place").alias("_place"), "_split", F.col("_part").alias("_at"), "_below")
    rows = rows.join(near, (F.col("place") == F.col("_place")) & F.col(split).eqNullSafe(F.col("_split")) & (F.col("_part") == F.col("_at")))
    own = F.row_number().over(Window.partitionBy("place", split, "_part").orderBy("_h", item))
    offered = rows.withColumn("_rank", F.col("_below") + own).where("_rank <= reach").select("place", item, split, "_rank")
    wanted = [(arms[i][0], arms[i][1]) for i in order]
    schema = T.StructType([T.StructField("arm", T.StringType()), T.StructField(item, pool.schema[item].dataType), T.StructField(split, pool.schema[split].dataType)])

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        taken: set = set()
        out = []
        for place, (name, n) in enumerate(wanted):
            left = frame[(frame["place"] == place) & ~frame[item].isin(taken)].sort_values("_rank")
            left = left.assign(turn=left.groupby(split, dropna=False).cumcount()).sort_values(["turn", split]).head(n)
            if len(left) < n:
                raise ValueError(f"arm {name} needs {n} items")
            taken.update(left[item])
            out.append(left.assign(arm=name)[["arm", item, split]])
        return pd.concat(out)

    # A row of no arm, so that arms of an empty pool are settled too, and found short.
    none = pool.sparkSession.range(1).select(F.lit(-1).alias("place"), F.lit(None).cast(pool.schema[item].dataType).alias(item), F.lit(None).cast(pool.schema[split].dataType).alias(split), F.lit(0).cast("long").alias("_rank"))
    return offered.unionByName(none).withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(settle, schema)


def proportional(pool: DataFrame, fraction: float, seed: str, split: str = "split", item: str = "item_id", least: int = 0) -> DataFrame:
    """Of each stratum round-half-even(count * fraction) items, `least` at least."""
    share = F.greatest(F.bround(F.count(F.lit(1)).over(Window.partitionBy(split)) * F.lit(fraction)), F.lit(least))
    return by_stratum(pool, split, seed, item).withColumn("_n", share).where(F.col("rn") <= F.col("_n")).drop("_n")


def proportional_to(pool: DataFrame, reference: DataFrame, n: int, seed: str, split: str = "split", item: str = "item_id") -> DataFrame:
    """About n items with the reference's mix of strata."""
    mix = reference.groupBy(split).agg(F.count(F.lit(1)).alias("_c"))
    total = mix.agg(F.sum("_c").alias("_t"))
    quota = mix.crossJoin(F.broadcast(total)).select(F.col(split), F.bround(F.lit(float(n)) * F.col("_c") / F.col("_t")).alias("_q"))
    return by_stratum(pool, split, seed, item).join(F.broadcast(quota), split).where(F.col("rn") <= F.col("_q")).drop("_q")


def global_rank(rows: DataFrame, column: str, name: str, parts: int = 64) -> DataFrame:
    """Gapless ranks from 0 in order of a numeric column, without an ordering of all rows in one task.

    Quantiles of the column cut it into parts; each ranks its own rows and adds the counts
    of the parts below. The table of counts has a row a part.
    """
    cuts = sorted(set(rows.approxQuantile(column, [i / parts for i in range(1, parts)], 0.005)))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c < F.col(column))) if cuts else F.lit(0)
    cut = rows.withColumn("_part", part)
    counts = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    below = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"))
    own = Window.partitionBy("_part").orderBy(column)
    ranked = cut.withColumn("_own", F.row_number().over(own) - 1).join(F.broadcast(counts), "_part")
    return ranked.withColumn(name, (F.col("_below") + F.col("_own")).cast("long")).drop("_part", "_own", "_below")


def cyclic_pairs(targets: DataFrame, episodes: DataFrame, n: int, item: str = "item_id", pos: str = "pos") -> DataFrame:
    """Target i in order of id gets episode i modulo n."""
    if n < 1:
        raise ValueError("no episodes")
    ranked = global_rank(targets, item, "_pos").withColumn("_pos", F.pmod(F.col("_pos"), F.lit(n)))
    return ranked.join(F.broadcast(episodes), F.col("_pos") == F.col(pos)).drop("_pos")


def fingerprint(pool: DataFrame, keys: list[str], pos: str, parts: list[str]) -> DataFrame:
    """16 hexadecimal digits over an ordered pool's text: its id, audit and repair of each member in order.

    A member is a row throughout: rows come sorted and go through one running SHA-256 a pool,
    so no row or task holds a pool's text. Such a hash can't be split; a pool is read by one task.
    """
    body = F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    rows = pool.select(*keys, F.col(pos).alias("_pos"), body.alias("_body")).repartition(*keys).sortWithinPartitions(*keys, "_pos", "_body")
    schema = T.StructType([*(pool.schema[k] for k in keys), T.StructField("n", T.LongType()), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kinds, n, digest = None, None, 0, hashlib.sha256()

        def told() -> pa.RecordBatch:
            columns = [*(pa.array([v], t) for v, t in zip(key, kinds, strict=True)), pa.array([n], pa.int64()), pa.array([digest.hexdigest()[:16]])]
            return pa.RecordBatch.from_arrays(columns, names=[*keys, "n", "fingerprint"])

        for batch in batches:
            kinds = [batch.column(k).type for k in keys]
            for *own, text in zip(*(batch.column(k).to_pylist() for k in keys), batch.column("_body"), strict=True):
                if own != key:
                    if n:
                        yield told()
                    key, n, digest = own, 0, hashlib.sha256()
                digest.update(text.as_py().encode())
                n += 1
        if n:
            yield told()

    return rows.mapInArrow(run, schema)
