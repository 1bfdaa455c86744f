"""Frequency of every distinct term, by occurrences and by records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselade.session import first_delivery

MAX_LIMIT_BYTES = 1 << 20  # limits larger than this are joined by shuffle


def _counted(values: Column) -> Column:
    """Distinct values of one record with their occurrences, nulls left out."""
    kept = F.filter(values, lambda v: v.isNotNull())
    return F.transform(F.array_distinct(kept), lambda v: F.struct(v.alias("term"), F.size(F.filter(kept, lambda x: x == v)).alias("n")))


def term_counts(df: DataFrame, key: str, fields: dict[str, Column], order: str | None = None) -> DataFrame:
    """(field, term, occurrences, records, all_records).

    ``fields`` maps a field name to a string array of each row; null arrays
    and null elements hold nothing, an empty or blank string is a term of its
    own. Each record emits its own term counts before any shuffle; records
    delivered again count once, and the counts are summed by partial
    aggregation, so a term that every record holds costs a row a task.
    ``all_records`` is the number of distinct keys, with terms or not. Rows
    without key belong to no record.
    """
    emitted = F.concat(*[F.transform(F.coalesce(_counted(values), F.array()), _named(F.lit(name))) for name, values in fields.items()])
    # The record itself is emitted too, under no field, so that one aggregation gives all totals.
    whole = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("term"), F.lit(1).alias("n")))
    records = first_delivery(df, key, [F.concat(whole, emitted).alias("terms")], order)
    terms = records.select(F.explode("terms").alias("t")).select("t.*")
    counts = terms.groupBy("field", "term").agg(F.sum("n").cast("bigint").alias("occurrences"), F.count("*").alias("records"))
    total = counts.where("field is null").select("records")
    return counts.where("field is not null").withColumn("all_records", total.scalar())


def _named(name: Column):
    return lambda c: F.struct(name.alias("field"), c["term"].alias("term"), c["n"].alias("n"))


def marked(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """``counts`` with mark: ``rare``, ``common`` or null.

    ``limits`` has field, min_records and max_share. A term in fewer than
    ``min_records`` records is rare, one in more than ``max_share`` of all
    records common; rare goes first. A field without limits, and a limit that
    is null, mark nothing. Limits given twice are taken once, the strictest.
    """
    bounds = limits.where("field is not null").groupBy("field").agg(F.max("min_records").alias("min_records"), F.min("max_share").alias("max_share"))
    mark = F.when(F.col("records") < F.col("min_records"), "rare").when(F.col("records") > F.col("max_share") * F.col("all_records"), "common")
    size = bounds.agg(F.sum(F.octet_length("field") + 64)).first()[0] or 0
    bounds = F.broadcast(bounds) if size <= MAX_LIMIT_BYTES else bounds
    return counts.join(bounds, "field", "left").withColumn("mark", mark).drop("min_records", "max_share")
