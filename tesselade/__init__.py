"""Spark-first engine for structured-explanation datasets."""
