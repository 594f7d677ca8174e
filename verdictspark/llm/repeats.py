"""Removal of word windows that repeat anywhere, found from difference-cover anchors.

Positions whose remainder modulo a period lies in a difference cover are anchors: any
two positions have a common shift below the period that takes both to anchors. So two
equal windows of n words share an equal short window at an anchor of each. Only those
are hashed and shuffled at first; around anchors that repeat, the whole windows follow
and are compared themselves, by two 64-bit hashes made from their words' bytes with two
seeds.

Null and empty texts have no words; texts of fewer than n words lose none. All windows of
a text that occurs twice as a whole repeat, so it loses every word. Repeated rows count
as copies. Positions count words of the input, not of what is left. Windows are equal or
not, so there are no ties. Very long texts are read whole, piece by piece of a batch; their
places go to buckets like those of others. An empty table gives no rows. Only the id and text
columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictspark.llm.meeting import PACKED, buckets_for, deal, meet, positions
from verdictspark.llm.tables import join_hot, keep, read
from verdictspark.llm.words import Words, buffers, pieces, split, windows

#: Places that one bucket meets. A text's places come back in a row for each bucket, so small buckets multiply rows.
BUCKET_PLACES = 1_500_000
#: Perfect difference sets, by period.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}


def cover_for(n: int) -> tuple[int, tuple[int, ...]]:
    """The longest period whose anchors, n - period + 1 words long, keep two fifths of a window."""
    period = max((p for p in COVERS if 5 * (n - p + 1) >= 2 * n), default=1)
    return period, COVERS.get(period, (0,))


def joined(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words each followed by a space, and where each begins in that."""
    size = words.end - words.start + 1
    at = np.cumsum(size) - size
    out = np.full(int(size.sum()), 0x20, dtype=np.uint8)
    own = size - 1
    first = np.cumsum(own) - own
    steps = np.arange(int(own.sum()))
    out[steps + np.repeat(at - first, own)] = words.data[steps + np.repeat(words.start - first, own)]
    return out, np.append(at, len(out))


def _keys(column: pa.Array) -> np.ndarray:
    data, at = buffers(column)
    raw = data.tobytes()
    return np.frombuffer(b"".join(hashlib.md5(raw[a:b], usedforsecurity=False).digest() for a, b in zip(at[:-1], at[1:], strict=True)), dtype="V16")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 4 << 20):
        words = split(batch.column("text"))
        body, at = joined(words)
        raw = body.tobytes()
        shas = [hashlib.sha256(raw[at[a] : max(at[a], at[b] - 1)]).hexdigest() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        keys = pa.array([k.tobytes() for k in _keys(batch.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), keys, pa.array(words.counts()), pa.array(shas)], names=["doc_id", "key", "n_words", "whole_sha256"])


def _anchors(n: int, buckets: int):  # noqa: ANN202
    period, cover = cover_for(n)
    short = n - period + 1
    chosen = np.zeros(period, dtype=bool)
    chosen[list(cover)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            keys = _keys(batch.column("text"))
            once = np.sort(np.unique(keys, return_index=True)[1])
            keys, words = keys[once], split(batch.column("text").take(pa.array(once)))
            counts = words.counts()
            text = np.repeat(np.arange(len(counts)), counts)
            at = np.arange(len(text)) - np.repeat(words.first[:-1], counts)
            whole = counts[text] >= n
            goes = np.flatnonzero(whole & chosen[at % period] & (at + short <= counts[text]))
            short_hashes = windows(words.hashes(), short)
            yield deal(keys, text[goes], at[goes], short_hashes[goes], buckets)

    return run


def _whole_windows(n: int, buckets: int):  # noqa: ANN202
    period, _ = cover_for(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), dtype="V16")
            keys, once = np.unique(keys, return_index=True)
            batch = batch.take(pa.array(once))
            words = split(batch.column("text"))
            hashes, second, counts = words.hashes(), words.hashes(seed=1), words.counts()
            texts, ats = [], []
            for i, parts in enumerate(batch.column("found").to_pylist()):
                last = counts[i] - n
                near = positions(parts)
                delta = np.zeros(last + 2, dtype=np.int64)
                np.add.at(delta, np.clip(near - period + 1, 0, last + 1), 1)
                np.add.at(delta, np.minimum(near, last) + 1, -1)
                at = np.flatnonzero(np.cumsum(delta[:-1]) > 0)
                texts.append(np.full(len(at), i))
                ats.append(at)
            text, at = np.concatenate(texts), np.concatenate(ats)
            own = words.first[text] + at
            yield deal(keys, text, at, windows(hashes, n)[own], buckets, windows(second, n)[own])

    return run


def _removed(n: int, with_text: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            words = split(batch.column("text"))
            body, at = joined(words)
            out = []
            for i, parts in enumerate(batch.column("starts").to_pylist()):
                lo, hi = int(words.first[i]), int(words.first[i + 1])
                begins = positions(parts)
                delta = np.zeros(hi - lo + 1, dtype=np.int64)
                delta[begins] += 1
                delta[begins + n] -= 1
                stays = np.cumsum(delta[:-1]) == 0
                size = np.diff(at[lo : hi + 1])
                left = body[at[lo] : at[hi]][np.repeat(stays, size)].tobytes()[:-1]
                out.append((batch.column("key")[i].as_py(), int((~stays).sum()), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace") if with_text else None))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "removed", "left_sha256", "left_text"])

    return run


def without_repeats(docs: DataFrame, n: int = 35, text: str = "text", id_col: str = "doc_id", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; with_text adds kept_text where words went."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("id"), docs[text].alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    short = keep(rows.mapInArrow(_summaries, f"doc_id {id_type}, key binary, n_words long, whole_sha256 string"), "repeat-rows")
    n_words = short.agg(F.sum("n_words")).first()[0] or 0
    copies = short.where(F.col("n_words") >= n).groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))

    period, cover = cover_for(n)
    anchors = rows.select("text").mapInArrow(_anchors(n, buckets_for(spark, n_words * len(cover) / period, BUCKET_PLACES)), PACKED)
    near = meet(anchors).groupBy("key").agg(F.collect_list("at").alias("found"))
    near = near.join(copies, "key")
    keyed = rows.withColumn("key", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    held = keyed.join(near, (keyed["key"] == near["key"]) & keyed["id"].eqNullSafe(near["first_id"]))
    held = keep(held.select(near["key"], "text", "found", "copies"), "repeat-texts")

    places = n_words // 4
    whole = held.select("key", "text", "found").mapInArrow(_whole_windows(n, buckets_for(spark, places, BUCKET_PLACES)), PACKED)
    starts = meet(whole).groupBy("key").agg(F.collect_list("at").alias("starts"))
    lost = held.where("copies = 1").select("key", "text").join(starts, "key")
    lost = lost.mapInArrow(_removed(n, with_text), "key binary, removed long, left_sha256 string, left_text string")

    every = F.coalesce(F.col("copies") > 1, F.lit(False))
    out = join_hot(short, copies.drop("first_id").join(lost, "key", "left"), "key")
    columns = [
        "doc_id",
        "n_words",
        F.when(every, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(every, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("left_sha256", "whole_sha256")).alias("kept_sha256"),
    ]
    return out.select(*columns, *([F.when(every, F.lit("")).otherwise(F.col("left_text")).alias("kept_text")] if with_text else []))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 35-word windows that occur elsewhere."""
    return without_repeats(read(spark, sf_dir, "documents"), 35)
