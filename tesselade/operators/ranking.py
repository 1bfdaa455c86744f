"""Ranks and running sums over groups of any size.

A window over one group runs in one task, and a group may hold a third of all
rows. Here the rows are range-partitioned by group and order, numbered within
(group, partition), and shifted by the totals of the partitions before, of which
there are as many as partitions and groups, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselade.session import materialise


def running(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds ``rank`` (from 1) and the running total of each of ``sums``.

    ``order`` must tell all rows of a group apart. Null groups are groups.
    """
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = df.withColumns({f"_{n}": c for n, c in sums.items()})
    placed = placed.repartitionByRange(int(parts), *[F.col(g) for g in group], *order).withColumn("_part", F.spark_partition_id())
    placed = materialise(placed)
    totals = placed.groupBy(*group, "_part").agg(F.count("*").alias("_n"), *[F.sum(f"_{n}").alias(f"_t_{n}") for n in sums])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*group, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_s"), *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_s_{n}") for n in sums])
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumn("_rank", F.row_number().over(inside)).withColumns({f"_r_{n}": F.sum(f"_{n}").over(upto) for n in sums})
    same = F.col("_part") == F.col("_q_part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_q_{g}"))
    rows = rows.join(shifts.toDF(*[f"_q_{g}" for g in group], "_q_part", "_s", *[f"_s_{n}" for n in sums]), same)
    return rows.select(*df.columns, (F.col("_s") + F.col("_rank")).cast("bigint").alias("rank"), *[(F.col(f"_s_{n}") + F.col(f"_r_{n}")).alias(n) for n in sums])


def shuffled(df: DataFrame, group: list[str], key: str, seed: int) -> DataFrame:
    """Adds ``rank``: a repeatable random order within each group."""
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return running(df.withColumn("_mixed", mixed), group, [F.col("_mixed"), F.col(key)], {}).drop("_mixed")
