"""Periodic runs in word sequences: factors from a suffix automaton, crossing runs, copies of earlier ones.

A run is a stretch of words with smallest period q, at least `exponent` times q and `least`
words long, which no neighbouring word extends. For each text:

1. Words are numbered. Where such a run lies, every window of some fixed number of words
   (9 for 24 words and three periods) occurs twice, so only stretches of repeated windows
   are looked at further. That can't lose a run: it lies in one stretch as a whole.
2. A stretch is cut into factors, each the longest that occurs before (or a new word), by
   a suffix automaton that knows where each state's words first end.
3. At each border between factors, runs that cross or touch it and end in the factor
   behind it are found from longest common extensions to both sides, period by period.
4. Runs inside a factor are those of its earlier occurrence, moved.

Steps 2 to 4 take time and memory in proportion to the stretch. One row's text is one
task's work; nothing of another row is needed, so nothing is shuffled.

Null, empty and blank texts have no words and no runs. A text that is one word over and over
is one run of period 1. Very long texts are read whole, one at a time. Repeated rows give
repeated results; of equally high runs the first, then the one of smaller period, is the
highest. An empty table gives no rows. Other columns may have any names: they aren't read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictspark.llm.tables import bound_batches, read
from verdictspark.llm.words import mix, pieces, windows

LEAST, EXPONENT = 24, 3
RUN = "struct<start:long,length:long,period:long>"


class Automaton:
    """Suffix automaton of a word sequence; a state holds its first edge in place, further ones in a dictionary."""

    def __init__(self, seq: list[int]) -> None:
        room = 2 * len(seq) + 1
        self.word, self.to = array("q", [-1]) * room, array("q", [-1]) * room
        self.more: dict[int, dict[int, int]] = {}
        self.ends = array("q", [-1]) * room
        self.longest, self.link = array("q", [0]) * room, array("q", [-1]) * room
        self.states, last = 1, 0
        for at, w in enumerate(seq):
            last = self._append(at, w, last)

    def next(self, state: int, w: int) -> int:
        if self.word[state] == w:
            return self.to[state]
        others = self.more.get(state)
        return -1 if others is None else others.get(w, -1)

    def _edge(self, state: int, w: int, to: int) -> None:
        if self.word[state] in (-1, w):
            self.word[state], self.to[state] = w, to
        else:
            self.more.setdefault(state, {})[w] = to

    def _append(self, at: int, w: int, last: int) -> int:
        new = self.states
        self.states += 1
        self.longest[new], self.ends[new] = self.longest[last] + 1, at
        p = last
        while p >= 0 and self.next(p, w) < 0:
            self._edge(p, w, new)
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
            return new
        q = self.next(p, w)
        if self.longest[q] == self.longest[p] + 1:
            self.link[new] = q
            return new
        twin = self.states
        self.states += 1
        self.word[twin], self.to[twin], self.link[twin], self.ends[twin] = self.word[q], self.to[q], self.link[q], self.ends[q]
        self.longest[twin] = self.longest[p] + 1
        if q in self.more:
            self.more[twin] = dict(self.more[q])
        while p >= 0 and self.next(p, w) == q:
            self._edge(p, w, twin)
            p = self.link[p]
        self.link[q] = self.link[new] = twin
        return new


def factors(seq: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, earlier start): each the longest that also starts further left, or one new word (earlier start -1)."""
    known, out, at, n = Automaton(seq), [], 0, len(seq)
    while at < n:
        state, size, source = 0, 0, -1
        while at + size < n:
            state = known.next(state, seq[at + size])
            begins = known.ends[state] - size
            if begins >= at:
                break
            source, size = begins, size + 1
        out.append((at, max(size, 1), source))
        at += max(size, 1)
    return out


def overlaps(seq: list[int]) -> list[int]:
    """For each place the length of the longest common prefix with the whole."""
    n = len(seq)
    out, lo, hi = [n] * n, 0, 0
    for i in range(1, n):
        k = min(hi - i, out[i - lo]) if i < hi else 0
        if i + k >= hi:
            while i + k < n and seq[k] == seq[i + k]:
                k += 1
            lo, hi = i, i + k
        out[i] = k
    return out


def _common(of: list[int], with_: list[int]) -> list[int]:
    """For each place of `of` the longest common prefix of the rest with `with_`."""
    both = overlaps([*with_, -1, *of])
    return both[len(with_) + 1 :]


def _crossing(seq: list[int], border: int, back: int, end: int, least: int, exponent: int, found: dict[tuple[int, int], int]) -> None:
    """Runs that cross or touch the border, begin behind `back` and end at most at `end`.

    One word more than asked for lies on either side, so that ends are seen as such.
    """
    n, from_ = len(seq), max(back - 1, 0)
    left, right = seq[from_:border], seq[border : min(end + 1, n)]
    mirrored = left[::-1]
    own_right, own_left = overlaps(right), overlaps(mirrored)
    # How far the words before place p of `right` agree with those before the border, backwards.
    back_right = _common(right[::-1], mirrored)[::-1]
    # How far the words from place -p on agree with those behind the border.
    ahead_left = _common(left, right)[::-1]
    for p in range(1, len(right) + 1):
        before, after = back_right[p - 1], own_right[p] if p < len(right) else 0
        # A run with a whole period before the border is found from there.
        if before < p and before + p + after >= max(exponent * p, least):
            _note(seq, border - before, border + p + after, p, from_, end, found)
    for p in range(1, len(left) + 1):
        before, after = own_left[p] if p < len(left) else 0, ahead_left[p - 1]
        if after == p and p < len(right):
            after += own_right[p]
        if before + p + after >= max(exponent * p, least):
            _note(seq, border - p - before, border + after, p, from_, end, found)


def _note(seq: list[int], start: int, stop: int, p: int, from_: int, end: int, found: dict[tuple[int, int], int]) -> None:
    """Keeps a run that ends where it seems to: neither at the edge of what was seen nor behind the factor."""
    if stop > end or (start == from_ and start > 0 and seq[start - 1] == seq[start - 1 + p]):
        return
    if p < found.get((start, stop), p + 1):
        found[start, stop] = p


def runs_of(seq: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of at least that many words and periods (two or more)."""
    if exponent < 2:
        raise ValueError("a run has at least two periods")
    cut = factors(seq)
    starts: dict[int, list[tuple[int, int]]] = {}
    out: dict[tuple[int, int], int] = {}
    before = 0
    for start, size, source in [*cut, (len(seq), 0, -1)]:
        found: dict[tuple[int, int], int] = {}
        back = start - before - (before + size) // (exponent - 1) - 1
        if start:
            _crossing(seq, start, max(back, 0), start + size, least, exponent, found)
        for (a, b), p in found.items():
            if (a, b) not in out:
                out[a, b] = p
                starts.setdefault(a, []).append((b, p))
        if source >= 0 and size > least and starts:
            moved = start - source
            for a in range(source + 1, source + size - least):
                for b, p in starts.get(a, ()):
                    if b < source + size and (a + moved, b + moved) not in out:
                        out[a + moved, b + moved] = p
                        starts.setdefault(a + moved, []).append((b + moved, p))
        before = size
    return sorted((a, b - a, p) for (a, b), p in out.items())


def width(least: int, exponent: int) -> int:
    """Windows of so many words occur twice in any run: a run of L words has periods of at most L/exponent."""
    return min(n - 2 * (n // exponent) + 1 for n in range(least, least + exponent))


def stretches(ids: np.ndarray, least: int, exponent: int) -> Iterator[tuple[int, int]]:
    """Where windows that occur again follow one another for `least` words: no run lies elsewhere."""
    n = width(least, exponent)
    if len(ids) < least:
        return
    seen = windows(mix(ids.astype(np.uint64)), n)
    order = np.argsort(seen)
    same = seen[order[1:]] == seen[order[:-1]]
    again = np.zeros(len(seen) + 2, dtype=np.int8)
    again[order[1:][same] + 1] = 1
    again[order[:-1][same] + 1] = 1
    steps = np.diff(again)
    for a, b in zip(np.flatnonzero(steps == 1), np.flatnonzero(steps == -1), strict=True):
        if b - a + n - 1 >= least:
            yield int(a), int(b) + n - 1


def text_runs(words: list[bytes], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    if len(words) < least:
        return []
    numbers: dict[bytes, int] = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in words]
    return sorted((a + s, n, p) for a, b in stretches(np.array(ids), least, exponent) for s, n, p in runs_of(ids[a:b], least, exponent))


def kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that lie in a run after its first period."""
    out, at = [], 0
    for a, b in sorted((s + p, s + n) for s, n, p in runs):
        if b > at:
            out += words[at : max(a, at)]
            at = b
    return out + words[at:]


def reshaped(words: list[bytes], key: int) -> list[bytes]:
    """One in ten keys makes the words from some place on repeat with some period."""
    n, g = len(words), key // 10
    if key % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


def _found(least: int, exponent: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            counts, runs, texts = [], [], []
            for text, key in zip(batch.column("text").to_pylist(), batch.column("key").to_pylist(), strict=True):
                words = (text or "").encode().split()
                if key is not None:
                    words = reshaped(words, key)
                own = text_runs(words, least, exponent)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                texts.append(b" ".join(kept(words, own)).decode())
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            columns = [batch.column("id"), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, text: str = "text", id_col: str = "doc_id", key: Column | None = None) -> DataFrame:
    """The id, n_words, runs (by start, then period) and the text without repeated periods, of every row.

    Where `key` isn't null the words are first made to repeat by it (see reshaped).
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text].alias("text"), (F.lit(None) if key is None else key).cast("long").alias("key"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(_found(least, exponent), f"id {kind}, n_words long, runs array<{RUN}>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, one in ten made to repeat, with digests of their runs and of the collapsed text."""
    docs = read(spark, sf_dir, "documents")
    out = periodic_runs(docs, key=F.crc32(docs["doc_id"].cast("string").cast("binary")))
    # The highest exponent, exactly: fractions are compared crosswise.
    higher = lambda a, b: (b["length"] * a["period"] > a["length"] * b["period"])
    best = F.aggregate("runs", F.lit(None).cast(RUN), lambda a, b: F.when(a.isNull() | higher(a, b), b).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    return out.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
