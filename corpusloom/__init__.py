"""Spark-first curation of speech and text corpora."""
