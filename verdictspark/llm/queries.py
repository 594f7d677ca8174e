"""The subpackage's queries for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from verdictspark.llm import decontamination, html_blocks, jaccard, media, merkle, packing, quality, repeats, reply_trees, runs, secret_scan, sharding, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_ngram_jaccard_join": jaccard.op3_ngram_jaccard_join,
    "op4_html_extraction": html_blocks.op4_html_extraction,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_media_columns": media.op8_media_columns,
    "op9_sharding": sharding.op9_sharding,
    "op10_substring_dedup": repeats.op10_substring_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_chat_formatting": reply_trees.op12_chat_formatting,
    "op13_periodic_runs": runs.op13_periodic_runs,
}

ORACLES: dict[str, str] = {"op11_merkle_manifest": merkle.OP11_SQL, "op12_chat_formatting": reply_trees.OP12_SQL}
