"""Joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(left: DataFrame, right: DataFrame, on: list[str], rows: int = 20_000) -> DataFrame:
    """Inner equi-join in which no key puts more than about ``rows`` left rows into a task.

    Keys with more rows than that are split by a hash of the left row, and
    their right rows go to every part. Adaptive execution splits partitions by
    their bytes; narrow rows of a hot key stay below its limits while their
    pairs don't, which this covers. The result is that of a plain join: null
    keys match nothing, repeated rows multiply.
    """
    hot = left.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > rows).select(*on, F.ceil(F.col("_n") / rows).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    split = left.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("_parts")
    spread = right.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return split.join(spread, [*on, "_salt"]).drop("_salt")
