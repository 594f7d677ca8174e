"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of consecutive words. Each passage is encoded from
surface features; gated attention (tanh times sigmoid) weighs the encodings, and the
weighted sum is scored. Weights are learnt from document labels alone.

Null and empty texts are one passage without words; very long ones have as many passages as
they need, in training too. Without labelled rows of both kinds every score is 0.5. Repeated
rows give repeated results, an empty table none. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictspark.llm.html_blocks import STOP_WORDS
from verdictspark.llm.labelled import fold, sample
from verdictspark.llm.tables import read
from verdictspark.llm.words import pieces, split

MOST_LABELLED = 8_000
PASSAGE_WORDS = 48
HIDDEN, GATE = 16, 8
FEATURES = 15

_CLASSES = [
    np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    np.isin(np.arange(256), list(b"0123456789")),
    np.isin(np.arange(256), list(b".,;:")),
    np.isin(np.arange(256), list(b"!?")),
    np.isin(np.arange(256), list(b"|<>{}[]\\/_=~^")),
    np.isin(np.arange(256), list(b"%*&$#@+")),
    np.arange(256) >= 128,
    np.isin(np.arange(256), list(b"\r\n")),
]
_PACKED = [_CLASSES[i].astype(np.uint64) + (_CLASSES[i + 1].astype(np.uint64) << np.uint64(32)) for i in range(0, 8, 2)]


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (one at least for each text), and each text's first one."""
    words = split(column)
    counts = words.counts()
    each = np.maximum(-(-counts // PASSAGE_WORDS), 1)
    first = np.concatenate([[0], np.cumsum(each)])
    of = np.repeat(np.arange(len(counts)), each)
    lo = words.first[:-1][of] + (np.arange(len(of)) - first[of]) * PASSAGE_WORDS
    hi = np.minimum(lo + PASSAGE_WORDS, words.first[1:][of])
    n = np.maximum(hi - lo, 1).astype(float)
    out = np.zeros((len(of), FEATURES), dtype=np.float32)
    full = hi > lo
    a, b = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    a[full], b[full] = words.start[lo[full]], words.end[hi[full] - 1]
    size = np.maximum(b - a, 1).astype(float)
    for k, table in enumerate(_PACKED):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(table[words.data])])
        got = sums[b] - sums[a]
        out[:, 2 * k] = (got & np.uint64(0xFFFFFFFF)).astype(float) / size
        out[:, 2 * k + 1] = (got >> np.uint64(32)).astype(float) / size
    h = words.hashes(fold=True)
    if len(h):
        passage = np.repeat(np.arange(len(of)), hi - lo)
        stops = np.isin(h, _stops())
        out[:, 8] = np.bincount(passage, weights=stops, minlength=len(of)) / n
        again = np.zeros(len(h))
        again[1:] = h[1:] == h[:-1]
        out[:, 9] = np.bincount(passage, weights=again, minlength=len(of)) / n
        key = np.sort((passage.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        out[:, 10] = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=len(of)) / n
        length = (words.end - words.start).astype(float)
        out[:, 11] = np.bincount(passage, weights=length, minlength=len(of)) / n / 10
        out[:, 12] = np.bincount(passage, weights=length == 1, minlength=len(of)) / n
        out[:, 13] = np.bincount(passage, weights=length > 20, minlength=len(of)) / n
    out[:, 14] = np.log1p(n) / 4
    return out, first


_known: dict[str, np.ndarray] = {}


def _stops() -> np.ndarray:
    if "stops" not in _known:
        _known["stops"] = np.sort(split(pa.array([" ".join(sorted(STOP_WORDS))])).hashes(fold=True))
    return _known["stops"]


def _softmax(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    each = np.diff(first)
    e = np.exp(x - np.repeat(np.maximum.reduceat(x, first[:-1]), each))
    return e / np.repeat(np.add.reduceat(e, first[:-1]), each)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.maximum(x @ p["w"] + p["b"], 0)
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        weight = _softmax((t * s) @ p["a"], first)
        bag = np.add.reduceat(h * weight[:, None], first[:-1])
        z = bag @ p["c"] + p["d"][0]
        return {"x": x, "h": h, "t": t, "s": s, "weight": weight, "bag": bag, "score": 1 / (1 + np.exp(-np.clip(z, -40, 40)))}

    def score(self, column: pa.Array) -> np.ndarray:
        if not self.p:
            return np.full(len(column), 0.5)
        return self.forward(*passages(column))["score"].astype(float)


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = 300, seed: int = 5) -> Model:
    """Full-batch Adam on the cross entropy of document labels."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {"w": draw(FEATURES, HIDDEN), "b": np.zeros(HIDDEN), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE), "a": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1)}
    model = Model(x.mean(0), x.std(0) + 1e-3, p)
    m = {k: np.zeros_like(a) for k, a in p.items()}
    v = {k: np.zeros_like(a) for k, a in p.items()}
    each = np.diff(first)
    for t in range(1, steps + 1):
        f = model.forward(x, first)
        dz = (f["score"] - y) / len(y)
        dbag = np.repeat(np.outer(dz, p["c"]), each, axis=0)
        dh = dbag * f["weight"][:, None]
        dweight = (dbag * f["h"]).sum(1)
        mean = np.repeat(np.add.reduceat(dweight * f["weight"], first[:-1]), each)
        dlogit = f["weight"] * (dweight - mean)
        gate = f["t"] * f["s"]
        dgate = np.outer(dlogit, p["a"])
        dt, ds = dgate * f["s"] * (1 - f["t"] ** 2), dgate * gate * (1 - f["s"])
        dh += dt @ p["v"].T + ds @ p["u"].T
        dh *= f["h"] > 0
        grad = {"c": f["bag"].T @ dz, "d": np.array([dz.sum()]), "a": gate.T @ dlogit, "v": f["h"].T @ dt, "u": f["h"].T @ ds, "w": f["x"].T @ dh, "b": dh.sum(0)}
        for k, g in grad.items():
            g = g + 1e-4 * p[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
            p[k] -= 0.02 * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return model


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training bags: all passages of each text."""
    for batch in pieces(batches):
        x, first = passages(batch.column("text"))
        bags = [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(bags, pa.binary())], names=["label", "bag"])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Fits the model on at most `most` labelled rows outside the held-out fold."""
    rows = sample(docs, labels, "quality", 3, 1, most).mapInArrow(_encode, "label int, bag binary").collect()
    y = np.array([float(r["label"] == 1) for r in rows])
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0), np.zeros(0), {})
    bags = [np.frombuffer(r["bag"], dtype=np.float32).reshape(-1, FEATURES) for r in rows]
    return train(np.concatenate(bags).astype(np.float64), np.concatenate([[0], np.cumsum([len(b) for b in bags])]), y)


def scored(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and score of every row; all passages of whole texts count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(batch.column("text")))], names=["doc_id", "score"])

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double"
    return docs.select(docs[id_col].alias("id"), docs[text].alias("text")).mapInArrow(run, schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learnt outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
