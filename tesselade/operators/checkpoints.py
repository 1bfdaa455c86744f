"""Ranking of checkpoint reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Report fields by weight.
RANKED_BY = ("overall_accuracy", "overall_macro_f1", "json_parse_rate", "rouge_l", "meteor")


def ranked_reports(reports: DataFrame, group: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds ``rank`` from 1 in each group: all fields falling, null last, then path.

    Reports are a handful a group; the window never sees data rows.
    """
    order = Window.partitionBy(*group).orderBy(*[F.desc_nulls_last(c) for c in RANKED_BY], "path")
    return reports.withColumn("rank", F.row_number().over(order))


def latest_checkpoint(names: DataFrame, name: str) -> DataFrame:
    """The ``checkpoint-N`` with the largest N, at most one row."""
    number = F.try_to_number(F.regexp_extract(name, r"checkpoint-(\d+)$", 1), F.lit("999999999999")).cast("bigint")
    return names.select(name, number.alias("step")).where("step is not null").orderBy(F.desc("step"), name).limit(1)
