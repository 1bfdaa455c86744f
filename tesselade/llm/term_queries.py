"""Queries on term frequencies of the derived targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselade.llm.terms import marked, term_counts
from tesselade.session import table


def _counts(spark, sf_dir):
    entries = F.col("evidence_trace_target.per_criterion")
    fields = {
        "artifact_taxonomy": entries.getField("artifact_taxonomy"),
        "support_type": entries.getField("support_type"),
        "quality_flags": F.col("quality_flags"),
    }
    counts = term_counts(table(spark, sf_dir, "derived"), "row_id", fields, "ingested_at")
    return marked(counts, table(spark, sf_dir, "term_limits"))


def p5_found(spark, sf_dir):
    return _counts(spark, sf_dir).where("mark is not null").select("field", "term", "mark")


def p5_counts(spark, sf_dir):
    return _counts(spark, sf_dir).select("field", "term", "occurrences", "records", "mark")


QUERIES = {"p5_found": p5_found, "p5_counts": p5_counts}

_COUNTS = """with one as (select * from derived where row_id is not null qualify row_number() over (partition by row_id order by ingested_at nulls last) = 1),
e as (select row_id, unnest(evidence_trace_target.per_criterion) as x from one),
t as (select 'artifact_taxonomy' as field, row_id, x.artifact_taxonomy as term from e union all select 'support_type', row_id, x.support_type from e
 union all select 'quality_flags', row_id, unnest(quality_flags) from one),
c as (select field, term, count(*) as occurrences, count(distinct row_id) as records from t where term is not null group by 1, 2),
m as (select c.field, term, occurrences, records, case when records < min_records then 'rare' when records > max_share * (select count(*) from one) then 'common' end as mark
 from c left join term_limits l on c.field = l.field)
"""
ORACLE = {
    "p5_found": _COUNTS + "select field, term, mark from m where mark is not null",
    "p5_counts": _COUNTS + "select field, term, occurrences, records, mark from m",
}
