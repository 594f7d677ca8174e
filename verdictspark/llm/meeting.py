"""Finds hashes that occur at more than one place, in packed buckets.

A place is a word position of a distinct text (its 16-byte key). Hashes have 64 bits, or
128 where a second 64 are given. Each batch sorts its
places by bucket and sends one packed row a bucket. Hashes that repeat inside a batch
are settled there, and only one of their places travels, so that a hash in a third of
all rows costs a place a batch. Buckets grow in number with the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PACKED = "bucket int, keys binary, counts binary, at binary, hashes binary, more binary"
FOUND = "key binary, at binary"
_NAMES = ["bucket", "keys", "counts", "at", "hashes", "more"]
_KEY = np.dtype("V16")


def buckets_for(spark: SparkSession, places: float, each: int = 1_500_000) -> int:
    """So many buckets that each meets about `each` places; two for each core at least."""
    return int(max(2 * spark.sparkContext.defaultParallelism, places // each + 1))


def planes(values: np.ndarray) -> bytes:
    """Byte planes of 32-bit numbers: small ones leave runs of zeros for the shuffle's compression."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _row(bucket: int, keys: np.ndarray, text: np.ndarray, at: np.ndarray, hashes: np.ndarray | None, more: np.ndarray | None = None) -> tuple:
    """Places in order of text and position; positions are kept as steps."""
    cut = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    step = at.copy()
    step[1:] -= at[:-1]
    step[cut] = at[cut]
    packed = [None if h is None else h.tobytes() for h in (hashes, more)]
    return (bucket, keys[text[cut]].tobytes(), np.diff(np.append(cut, len(text))).astype("<u4").tobytes(), planes(step), *packed)


def _unrow(keys: bytes, counts: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, n = np.frombuffer(keys, dtype=_KEY), np.frombuffer(counts, dtype="<u4").astype(np.int64)
    step = unplanes(at).astype(np.int64)
    sums = np.cumsum(step)
    before = np.concatenate([[0], sums])[np.cumsum(n) - n]
    return k, np.repeat(np.arange(len(k)), n), sums - np.repeat(before, n)


def _sorted(hashes: np.ndarray, more: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal hashes together, and where in it each value begins."""
    order = np.argsort(hashes, kind="stable") if more is None else np.lexsort((more, hashes))
    new = np.ones(len(order), dtype=bool)
    for h in (hashes,) if more is None else (hashes, more):
        s = h[order]
        new[1:] &= s[1:] == s[:-1]
    new[1:] = ~new[1:]
    return order, new


def _repeated(hashes: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Masks: hashes that occur more than once, and the first of each value."""
    order, new = _sorted(hashes, more)
    again = ~new
    again[:-1] |= ~new[1:]
    repeated, first = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
    repeated[order], first[order] = again, new
    return repeated, first


def deal(keys: np.ndarray, text: np.ndarray, at: np.ndarray, hashes: np.ndarray, buckets: int, more: np.ndarray | None = None) -> pa.RecordBatch:
    """A batch's places (text indexes the keys, in order; each key once) as packed rows."""
    rows = []
    if len(hashes):
        repeated, first = _repeated(hashes, more)
        if repeated.any():
            spot = int.from_bytes(keys[text[0]].tobytes()[:4], "little") % buckets
            rows.append(_row(spot, keys, text[repeated], at[repeated], None))
        goes = np.flatnonzero(first)
        bucket = ((hashes[goes] >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        met, edge = np.unique(bucket[order], return_index=True)
        for b, own in zip(met.tolist(), np.split(goes[order], edge[1:]), strict=True):
            rows.append(_row(b, keys, text[own], at[own], hashes[own], None if more is None else more[own]))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
    types = [pa.int32(), *[pa.binary()] * (len(_NAMES) - 1)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_NAMES)


def _meet(table: pa.Table) -> pa.Table:
    """One bucket: the places whose hash is also at another place."""
    keys, texts, ats, hashes, seconds, out_key, out_at = [], [], [], [], [], [], []
    base = 0

    def tell(k: np.ndarray, text: np.ndarray, at: np.ndarray) -> None:
        if not len(text):
            return
        cut = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        for a, b in zip(cut, np.append(cut[1:], len(text)), strict=True):
            out_key.append(k[text[a]].tobytes())
            out_at.append(at[a:b].astype("<u4").tobytes())

    for row in table.select(_NAMES[1:]).to_pylist():
        k, text, at = _unrow(row["keys"], row["counts"], row["at"])
        if row["hashes"] is None:
            tell(k, text, at)
            continue
        keys.append(k)
        texts.append(text + base)
        ats.append(at)
        hashes.append(np.frombuffer(row["hashes"], dtype=np.uint64))
        if row["more"] is not None:
            seconds.append(np.frombuffer(row["more"], dtype=np.uint64))
        base += len(k)
    if hashes:
        unique, same = np.unique(np.concatenate(keys), return_inverse=True)
        text, at, h = same[np.concatenate(texts)], np.concatenate(ats), np.concatenate(hashes)
        more = np.concatenate(seconds) if seconds else None
        repeated = np.flatnonzero(_repeated(h, more)[0])
        text, at, h = text[repeated], at[repeated], h[repeated]
        if len(h):
            order, new = _sorted(h, None if more is None else more[repeated])
            cut = np.flatnonzero(new)
            place = (text * (int(at.max()) + 1) + at)[order]
            differ = np.minimum.reduceat(place, cut) != np.maximum.reduceat(place, cut)
            mine = order[np.repeat(differ, np.diff(np.append(cut, len(h))))]
            mine = mine[np.lexsort((at[mine], text[mine]))]
            tell(unique, text[mine], at[mine])
    return pa.table({"key": pa.array(out_key, pa.binary()), "at": pa.array(out_at, pa.binary())})


def meet(dealt: DataFrame) -> DataFrame:
    """Rows (key, positions as 32-bit numbers) of places whose hash occurs elsewhere; a key may have several."""
    return dealt.groupBy("bucket").applyInArrow(_meet, FOUND)


def positions(parts: list[bytes]) -> np.ndarray:
    """The distinct positions in packed lists, in order."""
    return np.unique(np.frombuffer(b"".join(parts), dtype="<u4")).astype(np.int64)

