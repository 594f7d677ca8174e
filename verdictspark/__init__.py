"""Spark-native analytics over LLM-verifier verdicts."""
