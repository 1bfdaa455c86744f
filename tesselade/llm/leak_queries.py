"""Queries on evaluation texts inside the corpus."""

from __future__ import annotations

from tesselade.llm.leaks import leaks, without_leaks, without_spans
from tesselade.session import table


def _leaks(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def p7_found(spark, sf_dir):
    return _leaks(spark, sf_dir).selectExpr("doc_id", "item as item_id").distinct()


def p7_spans(spark, sf_dir):
    return _leaks(spark, sf_dir).selectExpr("doc_id", "item as item_id", "text_start", "item_start", "words")


def p7_clean(spark, sf_dir):
    """Documents that may stay in the training corpus."""
    return without_leaks(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id", _leaks(spark, sf_dir))


def p7_trimmed(spark, sf_dir):
    """Texts without the lines that hold passages."""
    return without_spans(table(spark, sf_dir, "documents"), "doc_id", "text", _leaks(spark, sf_dir))


QUERIES = {"p7_trimmed": p7_trimmed, "p7_found": p7_found, "p7_spans": p7_spans, "p7_clean": p7_clean}
ORACLE: dict[str, str] = {}
