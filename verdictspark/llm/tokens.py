"""Token ids of whole texts, each distinct word encoded once.

The public word-level vocabulary never joins characters across ASCII white space, so a
text's ids are its words' ids in order. Words are hashed in numpy, only unseen ones go
through the tokenizer, and ids are gathered for a whole batch. A second hash of each word
is compared with the cached one; texts of words whose first hashes alone agree are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from verdictspark.llm.words import Words, split

MOST_WORDS = 1_000_000
JOINED = 1000


class WordTokenizer:
    """Ids by a tokenizers file whose vocabulary marks the ends of words with </w>."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.closing = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closing[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.second = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of(self, words: list[str]) -> list[np.ndarray]:
        """Words of letters alone are one pre-token each and are encoded a thousand at a time."""
        out: list[np.ndarray | None] = [None] * len(words)
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        chunks = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)]
        for chunk, ids in zip(chunks, self._encode([" ".join(words[i] for i in c) for c in chunks]), strict=True):
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == len(chunk) and (not len(ids) or ends[-1] == len(ids)):
                for i, part in zip(chunk, np.split(ids, ends[:-1]), strict=True):
                    out[i] = part
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._encode([words[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _learn(self, words: Words, keys: np.ndarray, second: np.ndarray, where: np.ndarray) -> None:
        raw = words.data
        found = self._ids_of([raw[words.start[i] : words.end[i]].tobytes().decode("utf-8", "replace") for i in where])
        size = np.array([len(x) for x in found], dtype=np.int64)
        at = len(self.flat) + np.cumsum(size) - size
        place = np.searchsorted(self.keys, keys)
        new = ((self.keys, keys), (self.second, second), (self.at, at), (self.size, size))
        self.keys, self.second, self.at, self.size = (np.insert(a, place, b) for a, b in new)
        self.flat = np.concatenate([self.flat, *found])

    def encode(self, column: pa.Array, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by end_id, and where each text's ids begin."""
        words = split(column)
        keys, where, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        second = words.hashes(seed=1)
        if len(self.keys) + len(keys) > MOST_WORDS:
            self._forget()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        if not known.all():
            self._learn(words, keys[~known], second[where[~known]], where[~known])
            place = np.searchsorted(self.keys, keys)
        entry = place[back]
        if not np.array_equal(self.second[entry], second):
            found = [np.append(ids, np.uint32(end_id)) for ids in self._encode(["" if t is None else t for t in column.to_pylist()])]
            return np.concatenate(found), np.cumsum([0, *map(len, found)])
        size = self.size[entry]
        ends = np.cumsum(size)
        texts = len(words.first) - 1
        of_text = np.repeat(np.arange(texts), words.counts())
        out = np.full(int(ends[-1] if len(ends) else 0) + texts, end_id, dtype=np.uint32)
        steps = np.arange(len(out) - texts)
        out[steps + np.repeat(of_text, size)] = self.flat[steps + np.repeat(self.at[entry] - (ends - size), size)]
        before = np.concatenate([[0], ends])
        return out, before[words.first] + np.arange(texts + 1)


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each file and worker."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]
