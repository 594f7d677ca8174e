"""Bootstrap by draws over sufficient statistics of clusters.

Clusters enter as (sum, count) pairs, so a replicate costs a row a cluster however many
items there are; an item bootstrap is the same with an item for each cluster. Draws come
from integer arithmetic on the stream's digest, replicate and position: they are the same
in every task, retry and partitioning, and in the oracle.

A key of more than MOST_DRAWN clusters isn't drawn cluster by cluster. How often each of the
different (sum, count) pairs is drawn has a multinomial law, so a replicate is one
multinomial draw over their histogram: rates of a few samples have few values, however
many items. The law is the same; the draws are a counter-based generator's, keyed by the
stream and the block of replicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictspark.operators.refusals import refuse

SEED = 20260805


#: Clusters of which all draws' sums are broadcast; a larger table is shuffled to its draws.
BROADCAST_CLUSTERS = 500_000
#: Clusters of a key that are drawn one by one; beyond, their histogram is.
MOST_DRAWN = 5_000
#: Replicates of one task's row, and counts that it holds at once.
REPLICATE_BLOCK, HELD_COUNTS = 500, 1 << 21
_PRIME = (1 << 31) - 1


def stream_start(stream: Column, seed: int = SEED) -> Column:
    """28 bits of the stream's digest."""
    text = F.concat_ws(":", F.lit(str(seed)), stream)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")


def clusters(items: DataFrame, keys: list[str], cluster: str, values: list[str]) -> DataFrame:
    """A row for each cluster: sums and counts of the values' non-null rows."""
    aggs = [f(F.col(v)).alias(f"{p}_{v}") for v in values for f, p in ((lambda c: F.sum(c.cast("double")), "s"), (F.count, "n"))]
    return items.groupBy(*keys, F.col(cluster).alias("_cluster")).agg(*aggs)


def replicates(table: DataFrame, keys: list[str], values: list[str], reps: int, stream: Column, seed: int = SEED) -> DataFrame:
    """For each key and replicate, the mean of each value over as many drawn clusters as there are."""
    sizes = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    large = sizes.where(F.col("_k") > MOST_DRAWN)
    few, many, drawn = sizes.agg(F.count_if(F.col("_k") <= MOST_DRAWN), F.count_if(F.col("_k") > MOST_DRAWN), F.sum(F.when(F.col("_k") <= MOST_DRAWN, F.col("_k")))).first()
    if not many:
        return _drawn(table, keys, values, reps, stream, seed, drawn or 0)
    by_values = _by_values(table.join(F.broadcast(large.drop("_k")), keys), keys, values, reps, stream, seed)
    if not few:
        return by_values
    return _drawn(table.join(F.broadcast(large.drop("_k")), keys, "left_anti"), keys, values, reps, stream, seed, drawn).unionByName(by_values)


def _drawn(table: DataFrame, keys: list[str], values: list[str], reps: int, stream: Column, seed: int, count: int) -> DataFrame:
    """Cluster by cluster.

    Tasks share out the replicates, and a table of at most BROADCAST_CLUSTERS clusters travels
    to each: all draws of a replicate are then made and added up in one task.
    """
    own = Window.partitionBy(*keys)
    table = table.withColumn("k", (F.row_number().over(own.orderBy("_cluster")) - 1).cast("long")).withColumn("n_clusters", F.count(F.lit(1)).over(own))
    sizes = table.groupBy(*keys).agg(F.max("n_clusters").alias("_k")).withColumn("_start", stream_start(stream, seed))
    draws = table.sparkSession.range(reps).withColumnRenamed("id", "rep").crossJoin(F.broadcast(sizes)).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    # Each step has its own column, so that none is computed twice.
    draws = draws.withColumn("_x", (F.col("_start") + F.col("rep") * 1103515245 + F.col("_j") * 742938285 + 1) % _PRIME)
    for shift, factor in ((13, 1597334677), (16, 823117891)):
        draws = draws.withColumn("_x", F.col("_x").bitwiseXOR(F.shiftright("_x", shift)) * factor % _PRIME)
    draws = draws.select(*keys, "rep", (F.col("_x").bitwiseXOR(F.shiftright("_x", 15)) % F.col("_k")).alias("k"))
    joined = draws.join(F.broadcast(table) if count <= BROADCAST_CLUSTERS else table, [*keys, "k"])
    # try_divide: draws may hold no row of a value. Twelve digits keep ties with 0 free of the order of addition.
    mean = lambda v: F.round(F.try_divide(F.sum(f"s_{v}"), F.sum(f"n_{v}")), 12)
    return joined.groupBy(*keys, "rep").agg(*[mean(v).alias(v) for v in values])


def multinomial_means(histogram: np.ndarray, counts: np.ndarray, reps: int, start: int, block: int) -> np.ndarray:
    """One block's replicate means: a row a replicate, a column a value; NaN where no row of a value was drawn.

    histogram has the sums and counts of each value side by side, in any order.
    """
    order = np.lexsort((*histogram.T[::-1], counts))
    histogram, counts = histogram[order], counts[order]
    draw = np.random.Generator(np.random.Philox(key=[start, block]))
    total, out = int(counts.sum()), []
    share, step = counts / counts.sum(), max(1, HELD_COUNTS // len(counts))
    for a in range(0, reps, step):
        sums = draw.multinomial(total, share, size=min(step, reps - a)) @ histogram
        with np.errstate(invalid="ignore", divide="ignore"):
            out.append(sums[:, ::2] / sums[:, 1::2])
    return np.round(np.concatenate(out), 12)


def _by_values(table: DataFrame, keys: list[str], values: list[str], reps: int, stream: Column, seed: int) -> DataFrame:
    """By multinomial draws over each key's histogram; tasks share out blocks of replicates."""
    pairs = [f"{p}_{v}" for v in values for p in "sn"]
    rows = table.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in pairs])
    counted = rows.groupBy(*keys, *pairs).agg(F.count(F.lit(1)).alias("_c"))
    packed = counted.groupBy(*keys).agg(F.collect_list(F.array(*pairs)).alias("_h"), F.collect_list("_c").alias("_n")).withColumn("_start", stream_start(stream, seed))
    blocks = table.sparkSession.range(-(-reps // REPLICATE_BLOCK)).withColumnRenamed("id", "_block")
    todo = packed.crossJoin(F.broadcast(blocks)).repartition(*keys, "_block")
    schema = T.StructType([*(packed.schema[k] for k in keys), T.StructField("rep", T.LongType()), *(T.StructField(v, T.DoubleType()) for v in values)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column("_block")[i].as_py()
                first = block * REPLICATE_BLOCK
                n = min(REPLICATE_BLOCK, reps - first)
                means = multinomial_means(np.array(batch.column("_h")[i].as_py()), np.array(batch.column("_n")[i].as_py()), n, batch.column("_start")[i].as_py(), block)
                own = [pa.array([batch.column(k)[i].as_py()] * n, batch.column(k).type) for k in keys]
                told = [pa.array(np.where(np.isnan(m), None, m), pa.float64()) for m in means.T]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(first, first + n)), *told], names=[*keys, "rep", *values])

    return todo.mapInArrow(run, schema)


def unit_by_ids(items: DataFrame, keys: list[str], episode: str = "episode_id", item: str = "item_id") -> DataFrame:
    """Adds clustered and unit: the episode in keys whose items have episode ids, the item in those without any.

    The query fails on a key of which only some items have one.
    """
    ids = items.groupBy(*keys).agg((F.count(episode) > 0).alias("clustered"), F.count(episode).alias("_with"), F.count(F.lit(1)).alias("_all"))
    joined = items.join(F.broadcast(ids), keys)
    some = F.col("clustered") & (F.col("_with") < F.col("_all"))
    joined = refuse(joined, some, F.concat(F.lit("only some items have an episode: "), F.concat_ws("/", *keys)))
    unit = F.when(F.col("clustered"), F.concat(F.lit("e"), F.col(episode).cast("string"))).otherwise(F.concat(F.lit("i"), F.col(item).cast("string")))
    return joined.withColumn("unit", unit).drop("_with", "_all")


def intervals(reps: DataFrame, effects: DataFrame, keys: list[str], value: str, n_reps: int) -> DataFrame:
    """lo, hi, p and p_centred of each key's effect from its replicates.

    p has the floor 1 / n_reps; degenerate marks an interval of no width.
    """
    joined = reps.join(effects.select(*keys, "effect"), keys)
    m, floor = F.col(value), F.lit(1.0 / n_reps)
    out = joined.groupBy(*keys).agg(
        F.first("effect").alias("effect"), F.percentile(m, F.lit(0.025)).alias("lo"), F.percentile(m, F.lit(0.975)).alias("hi"),
        F.avg((m <= 0).cast("double")).alias("_below"), F.avg((F.abs(m - F.col("effect")) >= F.abs("effect") - 1e-9).cast("double")).alias("_far"),
    )
    return out.select(
        *keys, "effect", "lo", "hi", F.greatest(2 * F.least(F.col("_below"), 1 - F.col("_below")), floor).alias("p"),
        F.greatest(F.col("_far"), floor).alias("p_centred"), (F.col("lo") == F.col("hi")).alias("degenerate"),
    )


def bootstrap(items: DataFrame, keys: list[str], cluster: str, value: str, reps: int, stream: Column, seed: int = SEED) -> DataFrame:
    """The cluster bootstrap of a mean: effect, interval, p, n and n_clusters for each key."""
    usable = items.where(F.col(value).isNotNull())
    table = clusters(usable, keys, cluster, [value])
    effects = table.groupBy(*keys).agg((F.sum(f"s_{value}") / F.sum(f"n_{value}")).alias("effect"), F.sum(f"n_{value}").cast("long").alias("n"), F.count(F.lit(1)).alias("n_clusters"))
    found = intervals(replicates(table, keys, [value], reps, stream, seed), effects, keys, value, reps)
    return found.join(effects.select(*keys, "n", "n_clusters"), keys)


def widest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of several intervals for one key the widest, the first of equals."""
    best = Window.partitionBy(*keys).orderBy(F.desc(F.round(F.col("hi") - F.col("lo"), 12)), order)
    return rows.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def half_band(samples: DataFrame, keys: list[str], reps: int, stream: Column, item: str = "item_id", seed: int = SEED, alpha: float = 0.05) -> DataFrame:
    """The null band from split halves of items' samples.

    Only items with the greatest number of samples of their key count; an odd last sample
    is left out. band is the (1 - alpha) quantile of |mean difference| over item draws,
    scaled by sqrt(width / half) to the full width.
    """
    own = Window.partitionBy(*keys)
    wide = samples.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("_w")).withColumn("_width", F.max("_w").over(own)).where("_w = _width and _width >= 2")
    ranked = samples.withColumn("_s", F.row_number().over(Window.partitionBy(*keys, item).orderBy("sample")) - 1)
    half = F.floor(F.col("_width") / 2)
    joined = ranked.join(wide.select(*keys, item, "_width"), [*keys, item])
    flag = F.col("flag").cast("double")
    diffs = joined.groupBy(*keys, item, "_width").agg((F.avg(F.when(F.col("_s") < half, flag)) - F.avg(F.when((F.col("_s") >= half) & (F.col("_s") < 2 * half), flag))).alias("d"))
    table = clusters(diffs, keys, item, ["d"])
    widths = diffs.groupBy(*keys).agg(F.max("_width").alias("width"), F.count(F.lit(1)).alias("n_items"))
    bands = replicates(table, keys, ["d"], reps, stream, seed).groupBy(*keys).agg(F.percentile(F.abs("d"), F.lit(1 - alpha)).alias("_q"))
    joined = bands.join(widths, keys)
    scale = F.sqrt(F.col("width") / F.floor(F.col("width") / 2))
    return joined.select(*keys, "width", "n_items", (F.col("_q") / scale).alias("band"))
