"""A bounded sample of labelled rows for fitting the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictspark.llm.tables import discard, keep
from verdictspark.llm.words import mix, pieces, split, windows

SKETCHES = 3


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text modulo `parts`; 0 for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")), F.lit(0)) % parts


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, most: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label) of at most `most` labelled documents outside fold `held`, drawn by a hash of the id.

    Null labels and ids are skipped; of several labels of one id the greatest counts. The
    drawn ids, `most` rows at most, are broadcast to find their texts. Of rows of one label
    that agree in three minima of hashes over their word triples (copies always do, texts of
    similarity J with chance J^3) the one of the least text hash stays.
    """
    drawn = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col), parts) != held))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(most)
    )
    rows = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(drawn), F.col("_doc") == F.col("_id")).select("text", "label")
    sketched = keep(found.mapInArrow(_sketch, "text string, label int, s0 long, s1 long, s2 long"), f"labelled-{label}")
    one = sketched.groupBy("label", *(f"s{k}" for k in range(SKETCHES))).agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("_one"))
    out = keep(one.select(F.col("_one.text").alias("text"), "label"), f"distinct-{label}")
    discard(sketched)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds minima of three hashes over each text's word triples."""
    for batch in pieces(batches):
        words = split(batch.column("text"))
        h = words.hashes(fold=True)
        out = np.zeros((SKETCHES, batch.num_rows), dtype=np.uint64)
        for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            own = windows(h[a:b], min(3, b - a)) if b > a else h[:0]
            for k in range(SKETCHES):
                out[k, i] = mix(own + np.uint64(k * 0x51ED270B)).min() if len(own) else 0
        columns = [batch.column("text"), batch.column("label"), *(pa.array(o.view(np.int64)) for o in out)]
        yield pa.RecordBatch.from_arrays(columns, names=["text", "label", "s0", "s1", "s2"])
