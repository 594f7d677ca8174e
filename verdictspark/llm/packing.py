"""Best-fit packing of tokenised documents by bin completion.

Documents become pieces of at most `capacity` tokens. Their lengths, at most `capacity`
distinct values, are counted; the search runs over that table alone, whatever the input's
size: around the largest remaining length it enumerates undominated fillings, takes each
as often as the counts allow, prunes by the waste that a better solution could still
afford, and keeps best-fit solutions as incumbents. Pieces then look up the place of
their rank among those of their length. Neither documents nor pieces pass the driver.

Null and empty texts are one piece that holds the end id alone. Repeated rows are
documents of their own. Very long texts are cut into as many pieces as they need. An empty
table gives an empty result. Only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import itertools
import sys
import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictspark.llm.tables import keep, ranked, read
from verdictspark.llm.tokens import tokenizer
from verdictspark.llm.words import pieces as text_pieces

#: Lengths of a filling that are enumerated; more are added greedily.
DEPTH = 5
#: Distinct lengths up to which the fillings of a state are kept for later passes of the search.
REMEMBERED = 256

Filling = tuple[int, ...]
Pattern = tuple[int, Filling]


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """(times, lengths) by filling the bin of the largest length with the largest that fit."""
    left = {s: n for s, n in counts.items() if n}
    sizes = sorted(left)
    out = []
    while sizes:
        filling, room, i = [], capacity, len(sizes) - 1
        while i >= 0:
            take = min(left[sizes[i]], room // sizes[i])
            filling += [sizes[i]] * take
            room -= take * sizes[i]
            i = min(i, bisect_right(sizes, room)) - 1
        times = min(left[s] // k for s, k in Counter(filling).items())
        out.append((times, tuple(filling)))
        _use(left, sizes, filling, times)
    return out


def _use(left: dict[int, int], sizes: list[int], filling: list[int] | Filling, times: int) -> None:
    for s, k in Counter(filling).items():
        left[s] -= k * times
        if not left[s]:
            del left[s]
            sizes.remove(s)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The greater of the volume bound and the bounds that large lengths alone give."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    sizes = sorted(counts)
    for alpha in [s for s in sizes if s * 2 <= capacity] + [0]:
        big = sum(n for s, n in counts.items() if s > capacity - alpha)
        half = [(s, n) for s, n in counts.items() if capacity - alpha >= s > capacity // 2]
        rest = sum(s * n for s, n in counts.items() if capacity // 2 >= s >= alpha)
        slack = sum(n * (capacity - s) for s, n in half)
        best = max(best, big + sum(n for _, n in half) + max(0, -(-(rest - slack) // capacity)))
    return best


def dominates(a: Filling, b: Filling) -> bool:
    """Whether b's lengths can be grouped so that each group fits into a length of a of its own."""
    room = sorted(a, reverse=True)

    def fits(k: int) -> bool:
        if k == len(b):
            return True
        tried = set()
        for i, r in enumerate(room):
            if r >= b[k] and r not in tried:
                tried.add(r)
                room[i] -= b[k]
                if fits(k + 1):
                    return True
                room[i] += b[k]
        return False

    return fits(0)


def _sums(usable: list[int], room: int) -> list[int]:
    """Bit sets of the totals up to room of 0, 1, 2 ... lengths, at most DEPTH."""
    levels, mask = [1], (1 << (room + 1)) - 1
    for _ in range(min(DEPTH, room // usable[0])):
        total = 0
        for s in usable:
            total |= levels[-1] << s
        levels.append(total & mask)
    return levels


def _mirrored(bits: int, room: int) -> int:
    """The bit set with bit i at room - i."""
    return int(f"{bits:0{room + 1}b}"[::-1], 2)


def _of_total(total: int, m: int, single: int, mirrored: list[int], left: dict[int, int], room: int, most: int) -> Iterator[Filling]:
    """Fillings of m lengths, greatest first, that add up to total; at most `most` partial ones are tried."""
    tries = [most]

    def extend(rest: int, k: int, cap: int, chosen: list[int]) -> Iterator[Filling]:
        if k == 0:
            yield tuple(chosen)
            return
        # Lengths s of which k - 1 lengths make up the rest: bit rest - s of the level below is bit room - rest + s of its mirror.
        fit = single & (mirrored[k - 1] >> (room - rest)) & ((1 << (min(cap, rest) + 1)) - 1)
        while fit and tries[0] > 0:
            s = fit.bit_length() - 1
            if s * k < rest:
                return
            fit ^= 1 << s
            if chosen.count(s) < left[s]:
                tries[0] -= 1
                yield from extend(rest - s, k - 1, s, [*chosen, s])

    yield from extend(total, m, room, [])


def fillings(room: int, left: dict[int, int], sizes: list[int], waste: int, width: int) -> list[Filling]:
    """Undominated fillings of `room` that waste at most `waste`, least waste first, at most `width`.

    Totals are taken from the room downwards to what the waste bound allows, or until
    `width` undominated or 16 times as many fillings were found: those not looked at waste
    more. Fillings of up to DEPTH lengths are enumerated, and what room they leave is filled
    with the greatest lengths that fit.
    """
    usable = sizes[: bisect_right(sizes, room)]
    if not usable:
        return [()] if room <= waste else []
    levels, kept, seen = _sums(usable, room), [], set()
    mirrored = [_mirrored(level, room) for level in levels]
    for total in range(room, max(room - waste, usable[0]) - 1, -1):
        for m in range(1, len(levels)):
            if not levels[m] >> total & 1:
                continue
            for found in itertools.islice(_of_total(total, m, levels[1], mirrored, left, room, 8 * width), 2):
                filling, r, i = list(found), room - total, bisect_right(usable, room - total) - 1
                while i >= 0 and r > 0:
                    take = min(left[usable[i]] - filling.count(usable[i]), r // usable[i])
                    filling += [usable[i]] * max(take, 0)
                    r -= max(take, 0) * usable[i]
                    i = min(i, bisect_right(usable, r)) - 1
                done = tuple(sorted(filling, reverse=True))
                if done not in seen and not any(len(done) <= 12 and dominates(k, done) for k in kept):
                    kept.append(done)
                seen.add(done)
        if len(kept) >= width or len(seen) >= 16 * width:
            break
    return sorted(kept, key=lambda f: (room - sum(f), len(f), tuple(-x for x in f)))[:width]


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = 2000, width: int = 6) -> list[Pattern]:
    """The best packing found within `nodes` steps of the search; optimal where it meets the bound.

    The search takes each bin's fillings in order of waste, first always the best, then with
    one departure from that, then two and so on. The limits bound the search only: every
    length is packed whatever they are.
    """
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    total, bound = sum(s * n for s, n in counts.items()), lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    used = [sum(t for t, _ in best)]
    budget, cut = [nodes], [False]
    known: dict[tuple, list[Filling]] = {}
    left, sizes, path = dict(counts), sorted(counts), []
    volume = [total]

    def put(filling: Filling, times: int) -> None:
        """Takes a filling so many times, or gives it back if times is negative."""
        for s, k in Counter(filling).items():
            before = left.get(s, 0)
            left[s] = before - k * times
            if not left[s]:
                del left[s]
                sizes.pop(bisect_right(sizes, s) - 1)
            elif not before:
                insort(sizes, s)
        volume[0] -= sum(filling) * times

    def search(bins: int, waste: int, departures: int) -> None:
        nonlocal best
        if used[0] <= bound:
            return
        if not sizes:
            if bins < used[0]:
                used[0], best = bins, list(path)
            return
        if budget[0] <= 0:
            return
        budget[0] -= 1
        rest = best_fit(left, capacity) if budget[0] % 64 == 0 else None
        if rest is not None and bins + (n := sum(t for t, _ in rest)) < used[0]:
            used[0], best = bins + n, path + rest
        afford = (used[0] - 1) * capacity - total - waste
        if afford < 0 or bins + -(-volume[0] // capacity) >= used[0]:
            return
        top = sizes[-1]
        key = (tuple(left.items()), min(afford, capacity)) if len(left) <= REMEMBERED else None
        options = known.get(key) if key else None
        if options is None:
            put((top,), 1)
            options = fillings(capacity - top, left, sizes, min(afford, capacity), width) if sizes else [()]
            put((top,), -1)
            if key:
                known[key] = options
        cut[0] |= len(options) > departures + 1
        for skipped, option in enumerate(options[: departures + 1]):
            filling = (top, *option)
            lost = capacity - sum(filling)
            times = min(left[s] // k for s, k in Counter(filling).items())
            if lost:
                times = min(times, max(1, afford // lost))
            if lost * times > afford:
                continue
            put(filling, times)
            path.append((times, filling))
            search(bins + times, waste + lost * times, departures - skipped)
            path.pop()
            put(filling, -times)

    if used[0] > bound:
        depth = sys.getrecursionlimit()
        sys.setrecursionlimit(max(depth, 4 * len(counts) + 4000))
        try:
            departures = 0
            while budget[0] > 0 and used[0] > bound:
                cut[0] = False
                search(0, 0, departures)
                if not cut[0]:
                    break
                departures += 1
        finally:
            sys.setrecursionlimit(depth)
    return best


def places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first sequence, copies a sequence, offset) of each run of ranks."""
    out, taken, sequence = [], Counter(), 0
    for times, filling in patterns:
        offset = 0
        for s, k in sorted(Counter(filling).items(), reverse=True):
            out.append((s, taken[s], sequence, k, offset))
            taken[s] += k * times
            offset += s * k
        sequence += times
    return out


def token_pieces(docs: DataFrame, capacity: int, vocabulary: str, end_id: int = 0, text: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Each document's ids cut into pieces; with_ids keeps the ids themselves."""
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        for batch in text_pieces(batches):
            ids, at = tok.encode(batch.column("text"), end_id)
            each = -(-np.diff(at) // capacity)
            row = np.repeat(np.arange(len(each)), each)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            lo = at[row] + piece * capacity
            hi = np.minimum(lo + capacity, at[row + 1])
            ids = ids.astype("<u4", copy=False)
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(lo, hi, strict=True)]
            columns = [batch.column("id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece.astype(np.int64) * capacity), pa.array(hi - lo), pa.array(sums, pa.int64())]
            if with_ids:
                columns.append(pa.array([ids[a:b].astype(np.int32) for a, b in zip(lo, hi, strict=True)], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(docs[id_col].alias("id"), docs[text].alias("text")).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = 2048, nodes: int = 2000, width: int = 6) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece, length and ids_crc32."""
    spark = pieces.sparkSession
    pieces = keep(pieces, "pack-pieces")
    table = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = sorted(places(bin_completion(table, capacity, nodes, width)))
    length, first, sequence, copies, offset = (np.array(c, dtype=np.int64) for c in zip(*runs, strict=True)) if runs else [np.zeros(0, np.int64)] * 5
    shift = 1 << 44

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def placed(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s, r = size.to_numpy(), rank.to_numpy()
        k = np.searchsorted(length * shift + first, s * shift + r, side="right") - 1
        at = r - first[k]
        return pd.DataFrame({"sequence_id": sequence[k] + at // copies[k], "offset": offset[k] + at % copies[k] * s})

    out = ranked(pieces, "length", [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")])
    return out.withColumn("_place", placed("length", "rank")).select(
        *pieces.columns, F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset")
    )


def packed(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """Documents as packed pieces under the public word vocabulary (or another file of its kind)."""
    return pack(token_pieces(docs, capacity, vocabulary or public_tokenizers.path("word_bpe_49k.json")), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packed(read(spark, sf_dir, "documents"))
