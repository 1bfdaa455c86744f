"""Queries on samples with planned category shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselade.llm.cube import balanced_sample
from tesselade.session import table


def _drawn(spark, sf_dir):
    derived = table(spark, sf_dir, "derived").select("row_id", F.col("final_json_target.overall_likelihood").alias("category"), "ingested_at")
    return balanced_sample(derived, "row_id", "category", table(spark, sf_dir, "sample_targets"), "ingested_at")


def p4_found(spark, sf_dir):
    return _drawn(spark, sf_dir)[1].where("shortfall > 0").select("plan_id", "category")


def p4_report(spark, sf_dir):
    return _drawn(spark, sf_dir)[1].withColumn("imbalance", F.round("imbalance", 9))


def p4_sample(spark, sf_dir):
    return _drawn(spark, sf_dir)[0]


QUERIES = {"p4_found": p4_found, "p4_report": p4_report, "p4_sample": p4_sample}

_LINES = """with a as (select final_json_target.overall_likelihood as category, count(distinct row_id) as available from derived where row_id is not null group by 1),
l as (select plan_id, s.category, sample_rows, target_share, min_rows, cast(greatest(min_rows, round(target_share * sample_rows)) as bigint) as target, coalesce(available, 0) as available
 from sample_targets s left join a on a.category = s.category),
d as (select *, least(target, available) as drawn from l)
"""
ORACLE = {
    "p4_found": _LINES + "select plan_id, category from d where target > available",
    "p4_report": _LINES
    + """select plan_id, category, sample_rows, target_share, min_rows, target, available, drawn, target - drawn as shortfall,
 round(case when sum(drawn) over (partition by plan_id) > 0 then drawn / sum(drawn) over (partition by plan_id) - target_share end, 9) as imbalance from d""",
}
