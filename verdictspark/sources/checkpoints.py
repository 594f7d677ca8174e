"""Cells as JSON records and as partitioned tables: import, export, resume, refusals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictspark.operators.refusals import refuse_unmatched
from verdictspark.sources.runs import outstanding  # noqa: F401

CELL_SCHEMA = (
    "auditor string, condition string, family string, samples int, thinking boolean, max_tokens int, far double, item_ids array<string>, per_item_probs array<double>, "
    "per_item_flags array<array<int>>, per_item_steps array<int>, per_item_confidence array<double>, gold_labels array<int>, episode_ids array<string>, episode_fingerprint string"
)


def read_cells(spark: SparkSession, folder: str) -> DataFrame:
    """All records of a folder, one a file; of equal (auditor, family, condition) the last file name counts."""
    raw = spark.read.schema(CELL_SCHEMA).option("multiLine", True).option("allowNonNumericNumbers", True).json(folder)
    named = raw.withColumn("_file", F.col("_metadata.file_path"))
    last = named.groupBy("auditor", "family", "condition").agg(F.max("_file").alias("_file"))
    return named.join(last, ["auditor", "family", "condition", "_file"]).drop("_file")


def read_origins(spark: SparkSession, folders: list[str]) -> DataFrame:
    """The records of several folders with `place`, the number of their folder in the list, taken from each file's path.

    Of equal (auditor, family, condition) of one folder the last file name counts, as in read_cells.
    """
    places = spark.createDataFrame([(f.rstrip("/").split(":", 1)[-1].rstrip("/"), i) for i, f in reversed(list(enumerate(folders)))], "_folder string, place int").dropDuplicates(["_folder"])
    raw = spark.read.schema(CELL_SCHEMA).option("multiLine", True).option("allowNonNumericNumbers", True).json(folders)
    named = raw.withColumn("_file", F.col("_metadata.file_path"))
    named = named.withColumn("_folder", F.regexp_replace(F.regexp_replace("_file", r"^[a-z0-9]+:(//)?", ""), r"/[^/]*$", ""))
    keys = ["auditor", "family", "condition", "_folder"]
    last = named.groupBy(*keys).agg(F.max("_file").alias("_file"))
    return named.join(last, [*keys, "_file"]).join(F.broadcast(places), "_folder").drop("_file", "_folder")


def item_rows(cells: DataFrame) -> DataFrame:
    """A row for each item of each cell; NaN becomes null. Arrays of unequal length are refused."""
    n = F.size("item_ids")
    ok = cells.withColumn("_ok", F.when(F.size("per_item_probs") != n, F.raise_error(F.concat(F.lit("lengths differ in "), F.col("auditor"), F.lit("/"), F.col("condition")))).otherwise(F.lit(True))).where("_ok")
    either = lambda c, t: F.when(F.col(c).isNull(), F.transform("item_ids", lambda _: F.lit(None).cast(t))).otherwise(F.col(c)).alias(c)
    zipped = F.arrays_zip(F.col("item_ids"), F.col("per_item_probs"), either("per_item_steps", "int"), either("per_item_confidence", "double"), either("gold_labels", "int"), either("episode_ids", "string"))
    more = ["place"] if "place" in cells.columns else []
    rows = ok.select("auditor", "condition", "family", *more, F.posexplode(zipped).alias("ord", "r"))
    number = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
    return rows.select(
        "auditor", "condition", "family", *more, "ord", F.col("r.item_ids").alias("item_id"), number("r.per_item_probs").alias("p"), F.col("r.per_item_steps").alias("step"),
        number("r.per_item_confidence").alias("confidence"), F.col("r.gold_labels").alias("gold_label"), F.col("r.episode_ids").alias("episode_id"),
    )


def cell_records(items: DataFrame) -> DataFrame:
    """The rows of item_rows back as a record a cell, items in order."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "item_id", "p", "episode_id")))
    out = items.groupBy("auditor", "condition", "family").agg(F.avg("p").alias("far"), rows.alias("_r"))
    field = lambda name: F.transform("_r", lambda r: r[name])
    return out.select("auditor", "condition", "family", "far", field("item_id").alias("item_ids"), field("p").alias("per_item_probs"), field("episode_id").alias("episode_ids"))


def write_records(cells: DataFrame, folder: str) -> None:
    """Records as JSON, a folder for each auditor, family and condition; those present in cells are replaced."""
    cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False).partitionBy("auditor", "family", "condition").json(folder)


def write_evidence(verdicts: DataFrame, folder: str) -> None:
    """Every sample's verdict beside the cells, unparsed ones too."""
    write_partitioned(verdicts, folder)


def read_wordings(spark: SparkSession, folder: str, stem: str, schema: str, wordings: tuple[str, ...] = ("F1", "F2", "F3", "F4", "F5")) -> DataFrame:
    """Scored artefacts of all wordings: stem.json is F1's, stem_F2.json and so on the others'; absent ones have no rows."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = {s.getPath().getName() for s in system.listStatus(files)}
    named = [(w, f"{stem}.json" if w == "F1" else f"{stem}_{w}.json") for w in wordings]
    parts = [spark.read.schema(schema).option("multiLine", True).json(f"{folder}/{f}").withColumn("wording", F.lit(w)) for w, f in named if f in there]
    out = spark.createDataFrame([], f"{schema}, wording string")
    for part in parts:
        out = out.unionByName(part)
    return out


def require_same_budget(cells: DataFrame) -> None:
    """ValueError where cells of one auditor and family were generated with different reasoning flags or token limits."""
    odd = cells.groupBy("auditor", "family").agg(F.count_distinct(F.struct(F.coalesce("thinking", F.lit(False)), F.coalesce("max_tokens", F.lit(-1)))).alias("_n")).where("_n > 1").limit(1).collect()
    if odd:
        raise ValueError(f"cells of {odd[0]['auditor']}/{odd[0]['family']} differ in thinking or max_tokens")


def write_partitioned(rows: DataFrame, folder: str) -> None:
    """Partitions by auditor, family and condition; only those present in rows are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("auditor", "family", "condition").parquet(folder)


def require_all(wanted: DataFrame, found: DataFrame, key: str) -> None:
    """ValueError with examples where wanted keys are missing."""
    missing = [r[0] for r in wanted.join(found, key, "left_anti").select(key).limit(3).collect()]
    if missing:
        raise ValueError(f"missing {key}: {missing}")


def require_same_items(cells: DataFrame, base: str) -> None:
    """ValueError where a condition's items differ from those of `base` (same auditor and family)."""
    keys = ["auditor", "family", "item_id"]
    b = cells.where(F.col("condition") == base).select(*keys)
    others = cells.where(F.col("condition") != base)
    odd = others.join(b, keys, "left_anti").limit(1).count() or b.join(others.select(*keys).distinct(), keys, "left_anti").limit(1).count()
    if odd:
        raise ValueError(f"items differ from those of {base}")


def write_pool(rows: DataFrame, folder: str, auditor: str, model: str, family: str) -> None:
    """A pool or a set made from one, as rows that carry whose they are."""
    told = rows.select(F.lit(auditor).alias("auditor"), F.lit(model).alias("model"), F.lit(family).alias("family"), "*")
    told.write.mode("errorifexists").option("ignoreNullFields", False).json(folder)


def read_pool(spark: SparkSession, folder: str, auditor: str, schema: str) -> DataFrame:
    """A stored pool's rows; ValueError where it is another auditor's."""
    rows = spark.read.schema(f"auditor string, {schema}").json(folder)
    other = rows.where(~F.col("auditor").eqNullSafe(F.lit(auditor))).select("auditor").first()
    if other is not None:
        raise ValueError(f"{folder} belongs to {other['auditor']}, not to {auditor}")
    return rows.drop("auditor")


def require_cover(pool: DataFrame, made: DataFrame, cell: str, key: str = "item_id") -> DataFrame:
    """The pool as it is; the query fails on an episode without a counterpart in a set made from the pool: the cell would pair others."""
    return refuse_unmatched(pool, made, key, f"counterparts for {cell}")
