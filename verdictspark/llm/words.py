"""Vectorised word splitting and hashing over Arrow text columns.

A word is a maximal run of bytes other than space and TAB..CR. UTF-8 never uses
those bytes inside a longer character, so byte words and code-point words agree.
Null texts count as empty. Words of up to seven bytes have hashes of their own, one each. A
longer word's hash joins two chains over its bytes, eight at a time, with other factors, so
that neither can be run backwards alone; beyond LONG_WORD bytes it is a digest's. Every seed
changes how each eight bytes enter. Hashes are the same in every task and run.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Words of more bytes are told apart by a cryptographic digest.
LONG_WORD = 32
try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:
    _LIBC = None
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Separators for words of letters: every ASCII byte but letters.
NOT_LETTERS = np.zeros(256, dtype=bool)
NOT_LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_KEPT = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (the splitmix64 finaliser)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


@dataclass
class Words:
    """Words of several texts: text i owns words first[i]..first[i+1]."""

    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, fold: bool = False, chars: int | None = None, seed: int = 0) -> np.ndarray:
        """A hash for each word; fold lowers A-Z, chars keeps that many leading bytes."""
        size = self.end - self.start
        size = size if chars is None else np.minimum(size, chars)
        data = np.concatenate([_LOWER[self.data] if fold else self.data, np.zeros(LONG_WORD + 8, dtype=np.uint8)])
        eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data.data, strides=(1,))
        key, other = (mix(np.array([4 * seed + k], dtype=np.uint64) * _U(_BASE)) for k in (1, 2))
        head = eight[self.start] & _KEPT[np.minimum(size, 8)]
        out = mix((head | size.astype(np.uint64) << _U(56)) ^ key)
        long = np.flatnonzero(size > 7)
        if len(long):
            start, left = self.start[long], size[long]
            a, b = mix(head[long] ^ other) + left.astype(np.uint64) * key, mix(head[long] * _U(0xA0761D6478BD642F) + other)
            for k in range(8, LONG_WORD, 8):
                more = np.flatnonzero(left > k)
                if not len(more):
                    break
                part = eight[start[more] + k] & _KEPT[np.minimum(left[more] - k, 8)]
                a[more] = mix(a[more] * _U(0xD6E8FEB86659FD93) + mix(part + key))
                b[more] = mix(b[more] ^ mix(part * _U(0xE7037ED1A0B428DB) ^ other)) * _U(0x8EBC6AF09C88C6E3)
            out[long] = mix(a ^ mix(b + key))
        for i in np.flatnonzero(size > LONG_WORD):
            a = int(self.start[i])
            digest = hashlib.blake2b(data[a : a + int(size[i])].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little"))
            out[i] = int.from_bytes(digest.digest(), "little")
        return out


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]] if len(col) else data[:0], offsets - offsets[0]


def split(col: pa.Array, gaps: np.ndarray = SPACE) -> Words:
    """The words of each text, or the runs of bytes outside other `gaps`."""
    data, at = buffers(col)
    solid = ~gaps[data]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    inner = at[(at > 0) & (at < len(data))]
    opens[inner] = solid[inner]
    closes[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, at, start, end, np.searchsorted(start, at))


def trim() -> None:
    """Gives memory that this worker no longer uses back to the system: workers wait for their next task with what they hold."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` text bytes (a longer text alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.diff(buffers(batch.column(text))[1]))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, side="right")))
            yield batch.slice(a, b - a)
            a = b
    batch = None
    trim()


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive word hashes, by doubling."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    size, block, done, out = 1, words, 0, None
    rest = n
    while rest:
        if rest & 1:
            out = block if out is None else out[: len(out) - size] * _U(pow(_BASE, size, 1 << 64)) + block[done : done + len(out) - size]
            done += size
        rest >>= 1
        if rest:
            block = block[:-size] * _U(pow(_BASE, size, 1 << 64)) + block[size:] if len(block) > size else block[:0]
            size *= 2
    return mix(out[: len(words) - n + 1])
