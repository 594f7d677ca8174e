"""Toxicity by weak supervision.

Many voters look at a text, each for itself: lexicons of insults by language, insults
addressed to someone, threats, disguised spellings, repeats, shouted insults, words and word
stems that lean toxic among the annotated rows (a voter for each kind), the absence of all
of these, and the annotation where there is one. A generative model starts from the voters'
agreement (their majority) and estimates each one's accuracies by expectation-maximisation;
voters that go together beyond what the class explains are paired in a forest, and each pair
enters with its joint table. The posterior trains a logistic regression on words, stems and
voters' findings, which scores every text.

Null and empty texts get the score of a text without findings. Very long texts count whole.
Without annotated rows of both kinds every score is 0. Repeated rows give repeated results,
an empty table none. Only the id and text columns are read to score, whatever others are named.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictspark.llm.labelled import fold, sample
from verdictspark.llm.tables import read
from verdictspark.llm.words import NOT_LETTERS, Words, mix, pieces, split

MOST_LABELLED = 20_000
MOST_TERMS = 4096
STEMS = (5, 6, 7, 8)
#: Words between which an insult or a threat and a word of address belong together.
REACH = 5
#: The least likelihood ratio statistic by which a term leans toxic.
LEAN = 11.0

#: General insults, words of contempt, threats and words of address in the four languages.
LEXICONS = {
    "insults en": "idiot moron loser clown fool jerk dimwit imbecile halfwit creep pig bastard",
    "contempt en": "stupid dumb scum trash worthless pathetic disgusting ugly filth vermin garbage despicable",
    "insults de": "dummkopf trottel idiot versager vollidiot depp schwachkopf mistkerl schwein arschloch",
    "contempt de": "dumm abschaum widerlich ekelhaft wertlos erbärmlich dreck müll ungeziefer",
    "insults fr": "imbécile crétin abruti idiot débile connard salaud minable porc",
    "contempt fr": "ordure stupide dégoûtant répugnant méprisable pathétique vermine déchet",
    "insults es": "imbécil tonto payaso perdedor idiota cretino cabrón cerdo",
    "contempt es": "estúpido basura asqueroso inútil patético repugnante despreciable escoria",
}
THREATS = "kill hurt destroy beat shoot stab strangle umbringen töten schlagen tuer frapper détruire matar golpear destruir"
ADDRESS = "you your yours u du dich dir dein deine ihr euch tu toi te ton ta vous votre tú ti tus usted ustedes"
_PLAIN = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"013457$@ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"oieastsaabcdefghijklmnopqrstuvwxyz", strict=True):
    _PLAIN[_a] = _b


def terms(words: Words) -> Iterator[np.ndarray]:
    """For each word its hash, then those of its stems (longer words only; 0 elsewhere)."""
    yield words.hashes(fold=True)
    size = words.end - words.start
    for n in STEMS:
        stem = mix(words.hashes(fold=True, chars=n) + np.uint64(n))
        yield np.where(size > n, stem, np.uint64(0))


def _squeezed(words: Words) -> Words:
    """The texts with digits and signs read as letters and repeated letters as one."""
    data = _PLAIN[words.data]
    stays = np.ones(len(data), dtype=bool)
    stays[1:] = (data[1:] != data[:-1]) | (data[1:] >= 128)
    at = np.concatenate([[0], np.cumsum(stays)])[words.text_at]
    raw = data[stays]
    return split(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)]), NOT_LETTERS)


_known: dict[str, np.ndarray] = {}


def _hashed(text: str, squeezed: bool = False) -> np.ndarray:
    key = f"{squeezed}{text}"
    if key not in _known:
        words = split(pa.array([text]), NOT_LETTERS)
        _known[key] = np.unique((_squeezed(words) if squeezed else words).hashes(fold=True))
    return _known[key]


FINDINGS = [*LEXICONS, "addressed", "threat", "disguised", "several", "shouted", "exclaimed"]


def findings(words: Words) -> np.ndarray:
    """What the voters that need no annotation find in each text: 0 or 1 in the order of FINDINGS."""
    n = len(words.first) - 1
    text = np.repeat(np.arange(n), words.counts())
    h = words.hashes(fold=True)
    out = np.zeros((n, len(FINDINGS)), dtype=bool)
    insult = np.zeros(len(h), dtype=bool)
    for k, lexicon in enumerate(LEXICONS.values()):
        hit = np.isin(h, _hashed(lexicon))
        out[text[hit], k] = True
        insult |= hit
    at = len(LEXICONS)
    address, threat = np.isin(h, _hashed(ADDRESS)), np.isin(h, _hashed(THREATS))
    for k in range(1, REACH + 1):
        if len(h) > k:
            near = text[k:] == text[:-k]
            out[text[k:][near & (insult[k:] & address[:-k] | insult[:-k] & address[k:])], at] = True
            out[text[k:][near & threat[:-k] & address[k:]], at + 1] = True
    plain = np.bincount(text[insult], minlength=n)
    squeezed = _squeezed(words)
    owner = np.repeat(np.arange(n), squeezed.counts())
    every = np.isin(squeezed.hashes(fold=True), _hashed(" ".join(LEXICONS.values()), True))
    out[:, at + 2] = np.bincount(owner[every], minlength=n) > plain
    out[:, at + 3] = plain >= 2
    size = np.maximum(np.diff(words.text_at), 1)
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[words.text_at])
    out[:, at + 4] = (plain > 0) & (count((words.data >= 65) & (words.data <= 90)) / size > 0.3)
    loud = words.data == ord("!")
    out[:, at + 5] = (plain > 0) & (count(np.concatenate([[False], loud[1:] & loud[:-1]]) if len(loud) else loud) > 0)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each term's texts among toxic and clean ones, summed within a batch."""
    for batch in pieces(batches):
        words = split(batch.column("text"), NOT_LETTERS)
        text = np.repeat(np.arange(batch.num_rows), words.counts()).astype(np.uint64)
        label = np.asarray(batch.column("label"))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for h in terms(words):
            order = np.lexsort((text, h))
            h, t = h[order], text[order]
            own = np.ones(len(h), dtype=bool)
            own[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
            own &= h != 0
            h, toxic = h[own], label[t[own].astype(np.int64)] == 1
            unique, where = np.unique(h, return_inverse=True)
            bad = np.bincount(where, weights=toxic, minlength=len(unique)).astype(np.int64)
            out.append((unique, bad, np.bincount(where, minlength=len(unique)) - bad))
        term, bad, good = (np.concatenate(c) for c in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(bad), pa.array(good.astype(np.int64))], names=["term", "bad", "good"])


@dataclass
class Model:
    """Terms in order with their weights, the weights of the dense columns and the bias."""

    terms: np.ndarray
    weight: np.ndarray
    dense: np.ndarray
    bias: float

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term) of each distinct term in each text, and for each kind of term the words it hits in each text; the last row counts words hit by any."""
        n = len(words.first) - 1
        texts = np.repeat(np.arange(n), words.counts())
        each, any_ = np.zeros((len(STEMS) + 2, n)), np.zeros(len(texts), dtype=bool)
        if not len(self.terms):
            return texts[:0], texts[:0], each
        slots = np.zeros(1 << 16, dtype=bool)
        slots[(self.terms >> np.uint64(48)).astype(np.int64)] = True
        found = []
        for kind, h in enumerate(terms(words)):
            maybe = np.flatnonzero(slots[(h >> np.uint64(48)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.terms, h[maybe]), len(self.terms) - 1)
            real = self.terms[k] == h[maybe]
            any_[maybe[real]] = True
            each[kind] = np.bincount(texts[maybe[real]], minlength=n)
            found.append(texts[maybe[real]] * len(self.terms) + k[real])
        each[-1] = np.bincount(texts[any_], minlength=n)
        both = np.unique(np.concatenate(found))
        return both // len(self.terms), both % len(self.terms), each

    def score(self, words: Words) -> np.ndarray:
        n = len(words.first) - 1
        if not len(self.dense):
            return np.zeros(n)
        text, term, each = self.hits(words)
        z = np.bincount(text, weights=self.weight[term], minlength=n) + columns(each[-1], findings(words), words.counts()) @ self.dense + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def columns(hits: np.ndarray, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text: whether any word is hit, how many are and how densely (logarithms), and the findings."""
    return np.column_stack([hits > 0, np.log1p(hits), np.log1p(1000 * hits / np.maximum(counts, 50)), found])


def voters(each: np.ndarray, counts: np.ndarray, found: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Votes (1 toxic, -1 clean, 0 abstains) of every voter on every text; the annotation is the last.

    A kind of leaning terms votes where it hits two words or more, and one in 150.
    """
    votes = list(found.astype(np.int8).T)
    votes += [((hits >= 2) & (150 * hits >= counts)).astype(np.int8) for hits in each[:-1]]
    silent = ~np.any(votes, axis=0)
    votes.append(np.where(silent, -1, 0).astype(np.int8))
    votes.append(np.where(labels == 1, 1, -1).astype(np.int8))
    return np.column_stack(votes)


def forest(votes: np.ndarray, post: np.ndarray, least: float = 0.002) -> list[tuple[int, int]]:
    """Pairs of voters that go together within the classes: a spanning forest of greatest information."""
    n, m = votes.shape
    weigh = np.column_stack([1 - post, post])
    pairs = []
    for i in range(m):
        for j in range(i):
            info = 0.0
            for y in (0, 1):
                joint = np.bincount((votes[:, i] + 1) * 3 + votes[:, j] + 1, weights=weigh[:, y], minlength=9).reshape(3, 3) / n
                total = joint.sum()
                if total > 0:
                    apart = np.outer(joint.sum(1), joint.sum(0)) / total
                    some = joint > 1e-12
                    info += float((joint[some] * np.log(joint[some] / apart[some])).sum())
            pairs.append((info, i, j))
    root = list(range(m))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    out = []
    for info, i, j in sorted(pairs, reverse=True):
        if info > least and find(i) != find(j):
            root[find(i)] = find(j)
            out.append((i, j))
    return out


def label_model(votes: np.ndarray, rounds: int = 30, smooth: float = 0.5) -> np.ndarray:
    """Posterior of each row under voters with estimated accuracies and pairwise correlations.

    Starts from the majority of the votes (a tie leans to clean), in which voters that vote alike share one. From
    the second round on the pairs of a forest enter with the ratio of their joint table to
    the product of their own ones.
    """
    n, m = votes.shape
    with np.errstate(all="ignore"):
        alike = np.nan_to_num(np.abs(np.corrcoef(votes.T.astype(float))))
    post = 1 / (1 + np.exp(1.0 - 2.0 * (votes @ (1 / np.maximum((alike * (alike > 0.85)).sum(1), 1)))))
    for step in range(rounds):
        weigh = np.column_stack([1 - post, post])
        prior = np.clip(post.mean(), 1e-4, 1 - 1e-4)
        odds = np.full(n, np.log(prior / (1 - prior)))
        single = []
        for j in range(m):
            table = np.stack([np.bincount(votes[:, j] + 1, weights=weigh[:, y], minlength=3) + smooth for y in (0, 1)])
            single.append(np.log(table / table.sum(1, keepdims=True)))
            odds += (single[j][1] - single[j][0])[votes[:, j] + 1]
        for i, j in forest(votes, post) if step else []:
            code = (votes[:, i] + 1) * 3 + votes[:, j] + 1
            for y, sign in ((1, 1.0), (0, -1.0)):
                # Smoothing pulls a pair towards independence.
                prod = np.exp(single[i][y][:, None] + single[j][y][None, :]).ravel()
                joint = np.bincount(code, weights=weigh[:, y], minlength=9) + 9 * smooth * prod
                odds += sign * np.log(joint / joint.sum() / prod)[code]
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post


def logistic(rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, target: np.ndarray, width: int, steps: int = 400, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of sparse 0/1 columns, of dense columns, and the bias, by Adam on soft labels."""
    n = len(target)
    params = np.zeros(width + dense.shape[1] + 1)
    params[-1] = np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=params[cols], minlength=n) + dense @ params[width:-1] + params[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / n
        grad = np.concatenate([np.bincount(cols, weights=error[rows], minlength=width), dense.T @ error, [error.sum()]])
        grad[:-1] += decay * params[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params -= 0.05 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return params[:width], params[width:-1], float(params[-1])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Fits the model on at most `most` annotated rows outside the held-out fold."""
    rows = sample(docs, labels, "toxic", 5, 0, most)
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), sum(n for k, n in totals.items() if k != 1)
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 0.0)
    if not n1 or not n0:
        return none
    leaning = rows.mapInArrow(_count, "term long, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    both, share = F.col("bad") + F.col("good"), n1 / (n1 + n0)
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * F.lit(p)))).otherwise(0.0)
    odds = F.log((F.col("bad") + 0.5) / (n1 + 1)) - F.log((F.col("good") + 0.5) / (n0 + 1))
    chosen = leaning.where("bad >= 3").withColumn("lean", 2 * (part("bad", share) + part("good", 1 - share))).where((F.col("lean") >= LEAN) & (odds >= 1.5))
    top = chosen.orderBy(F.desc("lean"), "term").limit(MOST_TERMS).select("term").toPandas()
    keys = np.sort(top["term"].to_numpy(np.int64).view(np.uint64))
    model = Model(keys, np.zeros(len(keys)), np.zeros(0), 0.0)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = split(batch.column("text"), NOT_LETTERS)
            text, term, each = model.hits(words)
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
            per = [term[a:b].astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            found = [f.tobytes() for f in findings(words)]
            columns_ = [batch.column("label"), pa.array(per, pa.list_(pa.int32())), pa.array([e.tobytes() for e in each.T], pa.binary()), pa.array(found, pa.binary()), pa.array(words.counts())]
            yield pa.RecordBatch.from_arrays(columns_, names=["label", "terms", "hits", "found", "words"])

    marked = rows.mapInArrow(marks, "label int, terms array<int>, hits binary, found binary, words long").toPandas()
    text = np.repeat(np.arange(len(marked)), [len(t) for t in marked["terms"]])
    term = np.concatenate([np.zeros(0, np.int64), *(np.asarray(t, dtype=np.int64) for t in marked["terms"])])
    each = np.array([np.frombuffer(h) for h in marked["hits"]]).T
    found = np.array([np.frombuffer(f, dtype=bool) for f in marked["found"]])
    counts = marked["words"].to_numpy()
    post = label_model(voters(each, counts, found, marked["label"].to_numpy()))
    weight, dense, bias = logistic(text, term, columns(each[-1], found, counts), post, len(keys))
    return Model(keys, weight, dense, bias)


def scored(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(split(batch.column("text"), NOT_LETTERS)))], names=["doc_id", "score"])

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double"
    return docs.select(docs[id_col].alias("id"), docs[text].alias("text")).mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score stays below the threshold, all columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            yield batch.filter(pa.array(model.score(split(batch.column(text), NOT_LETTERS)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learnt outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
