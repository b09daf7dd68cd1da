"""Spark-first curation of paired text and signal corpora."""
