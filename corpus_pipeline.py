"""A training corpus from raw documents: five stages, each written before the next reads it.

Every stage works on all rows that its predecessor kept. The first four return the columns
of their input, whatever others it has; the last returns packed token pieces.

In every stage null texts count as empty and are kept as null: nothing in them is toxic, near
another, a leak or a secret, and they pack as one end id. Very long texts are read whole.
Repeated rows are documents of their own but for near duplicates, of which one stays. An
empty table gives an empty result. Labels or benchmark rows that are null are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdictspark.llm import decontamination, jaccard, packing, secret_scan, toxicity
from verdictspark.llm.tables import keep, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on this stage's labelled ones, rejects go.

    Without labelled documents of both kinds all stay.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each component of 5-word shingle sets at least 80 % alike: the least id, of equal ids the least text digest.

    Texts without words are near nothing and all stay.
    """
    return jaccard.one_of_each(docs, 5, 80, 100)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers, names or units, go."""
    return decontamination.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; their secrets are replaced and n_chars follows."""
    return secret_scan.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 2048 tokens."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: No stage is expressible in SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the table documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
