"""Runs against served models: answers staged task by task, one commit record a cell.

A run is a folder. `_staged/CELL/PART` holds answers as Parquet: a task's file is in place when
that task is done (the committer's second algorithm), whatever becomes of the job. Asking again
leaves out the keys that are there, so a run that was killed goes on where it stopped, at the
loss of what tasks in flight had been told. `CELL.json` is the record of a finished cell; it
appears by one rename, and cells that have one aren't asked again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictspark.sources import models

#: Requests of one task: what a killed task loses.
BLOCK = 64


class Run:
    def __init__(self, spark: SparkSession, folder: str, block: int = BLOCK) -> None:
        self.spark, self.folder, self.block = spark, folder.rstrip("/"), block
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, at: str) -> bool:
        return self._files.exists(self._path(at))

    def answers(self, cell: str, part: str, key: str = "item_id", kind: str = "string") -> DataFrame:
        """What the cell's part has been told so far; of a key that two tasks wrote, one task's rows."""
        at = f"{self.folder}/_staged/{cell}/{part}"
        schema = f"{key} {kind}, {models.ANSWERS}"
        if not self._exists(at):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(at).withColumn("_file", F.col("_metadata.file_path"))
        first = rows.groupBy(F.col(key).alias("_key")).agg(F.min("_file").alias("_first"))
        return rows.join(first, rows[key].eqNullSafe(F.col("_key")) & (F.col("_file") == F.col("_first"))).drop("_key", "_first", "_file")

    def ask(self, cell: str, part: str, prompts: DataFrame, answer: models.Answer, endpoint: models.Endpoint, samples: int, key: str = "item_id", **how: object) -> DataFrame:
        """The answers to all prompts (key, messages); only those not staged yet are asked for."""
        kind = prompts.schema[key].dataType.simpleString()
        left = outstanding(prompts.select(key, "messages"), self.answers(cell, part, key, kind), [key])
        count = left.count()
        if count:
            rows = models.generate(left.repartition(-(-count // self.block), key), answer, endpoint, samples, key, **how)
            rows.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{self.folder}/_staged/{cell}/{part}")
        return self.answers(cell, part, key, kind)

    def done(self, cell: str) -> bool:
        return self._exists(f"{self.folder}/{cell}.json")

    def commit(self, cell: str, record: dict) -> None:
        """The cell's record, whole or not at all; one that is there stays (FileExistsError)."""
        self._write(f"{self.folder}/{cell}.json", json.dumps(record, indent=1))

    def _write(self, at: str, text: str) -> None:
        draft = self._path(f"{self.folder}/_draft-{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self._exists(at) or not self._files.rename(draft, self._path(at)):
            self._files.delete(draft, False)
            raise FileExistsError(at)

    def records(self, schema: str) -> DataFrame:
        """The records of all finished cells."""
        return self.spark.read.schema(schema).option("multiLine", True).json(f"{self.folder}/*.json")


def outstanding(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What of a work list has no committed result yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")
