"""Queries on records that cross from evaluation into training."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselade.llm.overlap import overlap_pairs
from tesselade.session import table


def _pairs(spark, sf_dir):
    return overlap_pairs(table(spark, sf_dir, "derived"), table(spark, sf_dir, "split_rows"), "row_id", "image", "original_response")


def p2_found(spark, sf_dir):
    return _pairs(spark, sf_dir).select(F.least("train_row", "eval_row").alias("row_id_a"), F.greatest("train_row", "eval_row").alias("row_id_b")).distinct()


def p2_counts(spark, sf_dir):
    """Pairs, evaluation rows and training rows per evaluation split and source."""
    split = table(spark, sf_dir, "split_rows").where(F.col("split").isin("eval", "holdout")).select(F.col("row_id").alias("eval_row"), "split").distinct()
    source = table(spark, sf_dir, "derived").groupBy(F.col("row_id").alias("eval_row")).agg(F.min("source").alias("source"))
    pairs = _pairs(spark, sf_dir).select("train_row", "eval_row").distinct().join(split, "eval_row").join(source, "eval_row", "left")
    by_eval = pairs.groupBy("split", "source", "eval_row").agg(F.count("*").alias("pairs"))
    return by_eval.groupBy("split", "source").agg(F.sum("pairs").alias("pairs"), F.count("*").alias("eval_rows"))


def p2_overlaps(spark, sf_dir):
    """Overlap fractions of every evaluation record whose text is in training."""
    by_text = _pairs(spark, sf_dir).where("eval_overlap is not null").distinct()
    return by_text.groupBy("eval_row").agg(F.count("*").alias("train_rows"), F.max("eval_overlap").alias("overlap"))


QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts, "p2_overlaps": p2_overlaps}
ORACLE: dict[str, str] = {}
