"""Reading inputs, cutting lineage and ranking rows: what the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
#: A join's side of at most so many short rows is broadcast.
BROADCAST_ROWS = 200_000
#: Fewer keys than this are spread by join_hot, each held by more rows than the second number.
HOT_KEYS = 10_000
HOT_ROWS = 100
#: Rows that one task ranks at most.
MOST_RANKED = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session sets one of its
    own; a cluster's executors and driver share no local folder, so there it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="verdictspark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def _path(spark: SparkSession, at: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def bound_batches(spark: SparkSession) -> None:
    """Rows travel to Python in batches of BATCH_BYTES at most, where the session has Spark's own bound (64 MB).

    Texts differ in length by orders of magnitude, so a count of rows bounds no worker's memory.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("64m", "67108864b", "67108864"):
        spark.conf.set(name, str(BATCH_BYTES))


def keep(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: later steps
    reread files instead of recomputing, also when executors are lost. discard() removes
    the table; else it goes when the driver's file system closes."""
    spark = df.sparkSession
    bound_batches(spark)
    at = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    path, files = _path(spark, at)
    files.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(at)
    out._kept_at = at
    return out


def discard(*kept: DataFrame) -> None:
    """Removes tables that keep() wrote, once nothing reads them any more."""
    for df in kept:
        path, files = _path(df.sparkSession, df._kept_at)
        files.delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(side: DataFrame, count: int) -> DataFrame:
    """A side of short rows, broadcast where its counted rows allow; beyond that Spark shuffles both."""
    return F.broadcast(side) if count <= BROADCAST_ROWS else side


def share_of(total: int) -> int:
    """Rows of one key beyond which it is spread: fewer than HOT_KEYS keys can have so many."""
    return max(HOT_ROWS, total // HOT_KEYS + 1)


def join_hot(rows: DataFrame, side: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """Left join with a side that has each key once, without bringing a frequent key's rows together.

    Keys (null too) of more rows than share_of(total) are split into parts of about that
    many, and the side's row is repeated for each part. There are fewer than HOT_KEYS such
    keys, so their table is broadcast. rows should be a written table: it is read twice.
    """
    share = share_of(rows.count() if total is None else total)
    hot = rows.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > share)
    hot = F.broadcast(hot.select("_hot", F.ceil(F.col("_n") / F.lit(share)).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    salted = rows.join(hot, rows[key].eqNullSafe(hot["_hot"]), "left")
    salted = salted.withColumn("_part", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("_hot", "_parts")
    other = side.withColumnRenamed(key, "_side_key")
    other = other.join(hot, other["_side_key"].eqNullSafe(hot["_hot"]), "left")
    other = other.withColumn("_side_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_hot", "_parts")
    out = salted.join(other, (salted[key] == other["_side_key"]) & (salted["_part"] == other["_side_part"]), "left")
    return out.drop("_part", "_side_key", "_side_part")


def ranked(rows: DataFrame, key: str, by: list[Column], name: str = "rank") -> DataFrame:
    """Gapless ranks from 0 within each key without bringing a key's rows together.

    A key's rows are spread by the hash of `by` over as many parts as their number asks for;
    each part numbers its own rows, and adds the counts of the parts before it. Ties in
    `by` may take any order, but rows that agree in it stay in one part. rows should be a
    written table with few keys: it is read three times.
    """
    share = min(max(1000, rows.count() // (4 * partitions(rows.sparkSession))), MOST_RANKED)
    parts = rows.groupBy(F.col(key).alias("_key")).agg(F.ceil(F.count(F.lit(1)) / F.lit(share)).cast("int").alias("_parts"))
    salted = rows.join(parts, rows[key].eqNullSafe(F.col("_key")))
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64(*by), F.col("_parts")).cast("int")).drop("_key", "_parts")
    counts = salted.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col(key).alias("_key"), F.col("_salt").alias("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    own = Window.partitionBy(key, "_salt").orderBy(*by)
    numbered = salted.withColumn("_own", F.row_number().over(own) - 1)
    joined = numbered.join(counts, numbered[key].eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_part")))
    return joined.withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_salt", "_own", "_key", "_part", "_before")
