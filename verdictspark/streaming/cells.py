"""Cells from a folder as their files arrive: keyed state, the last file name winning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdictspark.sources.checkpoints import CELL_SCHEMA, item_rows, write_partitioned

CELL = ("auditor", "family", "condition")


def cell_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The latest record of each cell, as a streaming table to be written in update mode.

    The state holds one record a cell. A file that arrives late replaces a record only if
    its name comes after that record's, so any order of arrival ends in what a scan of the
    whole folder gives (read_cells).
    """
    raw = spark.readStream.schema(CELL_SCHEMA).option("multiLine", True).option("allowNonNumericNumbers", True).json(folder)
    rest = [c for c in raw.columns if c not in CELL]
    latest = raw.withColumn("_file", F.col("_metadata.file_path")).groupBy(*CELL).agg(F.max_by(F.struct(*rest), F.col("_file")).alias("_r"))
    return latest.select(*CELL, *[F.col("_r")[c].alias(c) for c in rest]).select(*raw.columns)


def follow(cells: DataFrame, folder: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Keeps the item rows of all cells under folder, a partition a cell; each batch replaces those of its cells."""

    def replace(batch: DataFrame, number: int) -> None:
        write_partitioned(item_rows(batch), folder)

    return cells.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(replace).trigger(**(trigger or {"availableNow": True})).start()
