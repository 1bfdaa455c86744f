"""Queries of derived targets, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselade.dims import CRITERIA, DEFAULT_EVIDENCE, FAKE, NEGATIVE_IN_TARGETS, REAL, TAXONOMY
from tesselade.functions import text as X
from tesselade.operators import derive, splits
from tesselade.operators.ranking import shuffled
from tesselade.plans.review_queries import _any
from tesselade.plans.text_queries import PREDICTED, sql_canonical, sql_clean, sql_key, sql_words
from tesselade.session import first_delivery, table

SEED = 42


def _traced(spark, sf_dir):
    rows = derive.step2_source(table(spark, sf_dir, "teacher_rows").select("image", "step2_internal", "step2_draft"))
    return rows.select("image", "overall", derive.trace(F.col("entries")).alias("traced"))


def final_json_target(spark, sf_dir):
    rows = _traced(spark, sf_dir).select("image", derive.final_json(F.col("overall"), F.col("traced")).alias("t"))
    return rows.select("image", F.col("t.overall_likelihood").alias("overall_likelihood"), F.posexplode("t.per_criterion").alias("idx", "e")).select("image", "overall_likelihood", "idx", "e.criterion", "e.evidence", F.col("e.`aigc score`").alias("score"))


def evidence_trace(spark, sf_dir):
    rows = _traced(spark, sf_dir).select("image", "overall", F.posexplode("traced").alias("idx", "e"))
    return rows.select("image", "overall", "idx", "e.*")


def compact_trace(spark, sf_dir):
    rows = _traced(spark, sf_dir).select("image", F.posexplode(derive.compact_trace(F.col("traced"))).alias("idx", "e"))
    return rows.select("image", "idx", "e.criterion", "e.evidence", "e.holmes_span")


def taxonomy_counts(spark, sf_dir):
    rows = _traced(spark, sf_dir).select(F.explode(derive.taxonomy_target(F.col("traced"))).alias("e")).select("e.*")
    return rows.groupBy("criterion", "artifact_taxonomy", "support_type").agg(F.count("*").alias("n"))


def consistency_target(spark, sf_dir):
    rows = _traced(spark, sf_dir).select("image", derive.consistency_target(F.col("overall"), F.col("traced")).alias("c"))
    return rows.select("image", "c.overall_consistent", "c.expected_overall_likelihood", F.posexplode("c.per_criterion").alias("idx", "e")).select("image", "overall_consistent", "expected_overall_likelihood", "idx", "e.criterion", "e.consistent", "e.reason")


def quality_flags(spark, sf_dir):
    return _traced(spark, sf_dir).select("image", F.array_join(derive.quality_flags(F.col("overall"), F.col("traced")), "|").alias("flags"))


def derived_manifest(spark, sf_dir):
    """Rows, flags and label counts of a derived build."""
    rows = _traced(spark, sf_dir).select(derive.final_json(F.col("overall"), F.col("traced"))["overall_likelihood"].alias("label"), F.size(derive.quality_flags(F.col("overall"), F.col("traced"))).alias("flags"))
    return rows.groupBy("label").agg(F.count("*").alias("rows"), F.sum("flags").alias("flags"))


def _labels(spark, sf_dir):
    return first_delivery(table(spark, sf_dir, "derived"), "row_id", [F.col("final_json_target.overall_likelihood").alias("label")], "ingested_at")


def dataset_summary(spark, sf_dir):
    rows = splits.row_summary(_labels(spark, sf_dir), "row_id", "label")
    return rows.withColumn("label_counts", F.array_join("label_counts", "|"))


def label_counts(spark, sf_dir):
    return _labels(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


def stratified_split(spark, sf_dir):
    return splits.stratified_split(_labels(spark, sf_dir), "row_id", "label", 0.1, SEED)


def split_summary(spark, sf_dir):
    return stratified_split(spark, sf_dir).groupBy("label", "split").agg(F.count("*").alias("n"))


def split_disjoint(spark, sf_dir):
    """The partition check of the stored splits: rows in both sides."""
    kept = table(spark, sf_dir, "split_rows")
    train = kept.where("split = 'train'").select("row_id")
    return train.intersect(kept.where("split <> 'train'").select("row_id"))


def stratified_sample(spark, sf_dir):
    return splits.stratified_sample(_labels(spark, sf_dir), "row_id", "label", 200, SEED)


def interleave_labels(spark, sf_dir):
    return splits.interleave(_labels(spark, sf_dir), "row_id", "label", SEED)


def balanced_slice(spark, sf_dir):
    return splits.balanced_slice(_labels(spark, sf_dir), "row_id", "label", 64, SEED)


def head_n(spark, sf_dir):
    """The first 200 rows in file order: a top-k report."""
    return _labels(spark, sf_dir).orderBy("row_id").limit(200)


def task_mix_assign(spark, sf_dir):
    return _labels(spark, sf_dir).select("row_id", splits.task_pick(F.col("row_id"), SEED, 1).alias("task"))


def semi_split_filter(spark, sf_dir):
    held = table(spark, sf_dir, "split_rows").where("split = 'eval'").select("row_id")
    return _labels(spark, sf_dir).join(held, "row_id", "left_semi")


def anti_missing(spark, sf_dir):
    """Derived rows that no split holds."""
    return _labels(spark, sf_dir).join(table(spark, sf_dir, "split_rows").select("row_id"), "row_id", "left_anti").select("row_id")


def positional_join(spark, sf_dir):
    """Derived rows with the source record of their line."""
    source = table(spark, sf_dir, "source_records").groupBy(F.col("line_no").alias("row_id")).agg(F.min("query").alias("query"))
    return _labels(spark, sf_dir).join(source, "row_id", "left").select("row_id", "label", "query", F.col("query").isNull().alias("missing"))


def shuffle_rotate(spark, sf_dir):
    """Each row with the row that follows in a shuffled order of its label, the last with the first."""
    ranked = shuffled(_labels(spark, sf_dir), ["label"], "row_id", SEED)
    sizes = ranked.groupBy(F.col("label").alias("l")).agg(F.count("*").alias("n"))
    turned = ranked.join(sizes, F.col("label").eqNullSafe(F.col("l"))).select("row_id", "label", F.when(F.col("rank") == F.col("n"), 1).otherwise(F.col("rank") + 1).alias("next_rank"))
    after = ranked.select(F.col("row_id").alias("next_row"), F.col("label").alias("l2"), F.col("rank").alias("r2"))
    return turned.join(after, (F.col("next_rank") == F.col("r2")) & F.col("label").eqNullSafe(F.col("l2"))).select("row_id", "next_row")


_NAMES = (
    "final_json_target evidence_trace compact_trace taxonomy_counts consistency_target quality_flags derived_manifest dataset_summary label_counts stratified_split split_summary split_disjoint "
    "stratified_sample interleave_labels balanced_slice head_n task_mix_assign semi_split_filter anti_missing positional_join shuffle_rotate"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}

_TARGET = sql_canonical("e.criterion", PREDICTED, sql_key, sql_clean("e.criterion"))
_CRIT = "crit(idx, criterion) as (values " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(CRITERIA)) + "),"
_TAX = " ".join(f"when c.criterion = '{c}' and {_any('lower(evidence)', m.split('|'))} then '{label}'" for c, rules in TAXONOMY.items() for label, m in rules)


def _norm(x):
    return f"case when {sql_clean(x)} in ('{REAL}', '{FAKE}') then {sql_clean(x)} else 'Uncertain' end"


_TRACE = f"""with {_CRIT}
t as (select row_number() over () as k, * from teacher_rows),
u as (select k, image, coalesce(len(step2_internal.per_criterion_draft), 0) > 0 as full_, step2_internal as i, step2_draft as d from t),
o as (select k, image, {_norm('case when full_ then i.overall_likelihood else d.overall_likelihood end')} as overall from u),
e as (select k, n, {_TARGET} as criterion, cast(coalesce(e.final_score, 0) <> 0 as integer) as score, e.evidence as ev, e.support_type as st, e.holmes_span as hs, e.non_applicable as na, e.artifact_score_conflict as ac
 from (select k, unnest(i.per_criterion_draft) as e, unnest(range(len(i.per_criterion_draft))) as n from u where full_) where e is not null
 union all select k, n, {_TARGET}, cast(coalesce(e.proposed_score, 0) <> 0 as integer), e.evidence, e.support_type, e.holmes_span, e.non_applicable, e.artifact_score_conflict
 from (select k, unnest(d.per_criterion_draft) as e, unnest(range(len(d.per_criterion_draft))) as n from u where not full_) where e is not null),
f as (select * from e qualify row_number() over (partition by k, criterion order by n) = 1),
c as (select o.k, image, overall, idx, crit.criterion, coalesce(score, 0) as score, case when {sql_clean('ev')} = '' then '{DEFAULT_EVIDENCE}' else {sql_clean('ev')} end as evidence,
 case when {sql_clean('st')} = '' then 'unsupported' else {sql_clean('st')} end as support_type, {sql_clean('hs')} as holmes_span, case when f.k is null then true else coalesce(na, false) end as non_applicable, coalesce(ac, false) as artifact_score_conflict
 from o cross join crit left join f on f.k = o.k and f.criterion = crit.criterion),
tr as (select *, case when score = 0 then 'none' {_TAX} else 'artifact_generic' end as artifact_taxonomy, max(score) over (partition by k) as pos, score = 1 and (evidence = '{DEFAULT_EVIDENCE}' or {_any('lower(evidence)', NEGATIVE_IN_TARGETS)} or support_type = 'unsupported') as loose from c),
fl as (select k, string_agg(flag, '|' order by o1, o2) as flags, count(*) as n from (
 select distinct k, -1 as o1, 0 as o2, case when overall = '{REAL}' and pos = 1 then 'real_has_positive_artifact' when overall = '{FAKE}' and pos = 0 then 'fake_has_no_positive_artifact' end as flag from tr
 union all select k, idx, 0, criterion || ':artifact_score_conflict' from tr where artifact_score_conflict union all select k, idx, 1, criterion || ':positive_without_evidence' from tr where score = 1 and evidence = '{DEFAULT_EVIDENCE}') where flag is not null group by k)
"""
_LABEL = f"case when overall <> 'Uncertain' then overall when pos = 1 then '{FAKE}' else '{REAL}' end"
_ONE = "lab as (select row_id, final_json_target.overall_likelihood as label from derived where row_id is not null qualify row_number() over (partition by row_id order by ingested_at nulls last) = 1)"
_RANKED = f"with {_ONE}, r as (select *, row_number() over (partition by label order by md5('{SEED}:' || row_id), row_id) as rank, count(*) over (partition by label) as n from lab)"
_SPLIT = _RANKED + ", s as (select row_id, label, case when rank <= case when n <= 1 then n else greatest(1, least(n - 1, round_even(n * 0.1::double, 0))) end then 'eval' else 'train' end as split from r)"

ORACLE = {
    "final_json_target": _TRACE + f"select image, {_LABEL} as overall_likelihood, idx, criterion, evidence, score from tr",
    "evidence_trace": _TRACE + "select image, overall, idx, criterion, score, evidence, support_type, holmes_span, artifact_taxonomy, non_applicable, artifact_score_conflict from tr",
    "compact_trace": _TRACE + f"select image, idx, criterion, case when evidence = '{DEFAULT_EVIDENCE}' then evidence else array_to_string(({sql_words('evidence')})[1:14], ' ') end as evidence, array_to_string(({sql_words('holmes_span')})[1:12], ' ') as holmes_span from tr",
    "taxonomy_counts": _TRACE + "select criterion, artifact_taxonomy, support_type, count(*) as n from tr group by 1, 2, 3",
    "consistency_target": _TRACE
    + f"""select image, overall = case when pos = 1 then '{FAKE}' else '{REAL}' end as overall_consistent, case when pos = 1 then '{FAKE}' else '{REAL}' end as expected_overall_likelihood, idx, criterion, not loose as consistent,
 case when loose then 'positive score lacks grounded artifact evidence' else 'evidence supports score' end as reason from tr""",
    "quality_flags": _TRACE + "select image, coalesce(flags, '') as flags from o left join fl on fl.k = o.k",
    "derived_manifest": _TRACE + f"select label, count(*) as rows, cast(sum(coalesce(n, 0)) as bigint) as flags from (select distinct k, {_LABEL} as label from tr) x left join fl on fl.k = x.k group by label",
    "dataset_summary": f"with {_ONE}, c as (select label, count(*) as n from lab group by 1) select (select count(*) from lab) as dataset_rows, (select min(row_id) from lab) as row_id_min, (select max(row_id) from lab) as row_id_max, (select cast(sum(row_id) as bigint) from lab) as row_id_checksum, (select string_agg(x, '|' order by x) from (select coalesce(label, 'null') || '=' || n as x from c)) as label_counts",
    "label_counts": f"with {_ONE} select label, count(*) as n from lab group by 1",
    "stratified_split": _SPLIT + " select row_id, label, split from s",
    "split_summary": _SPLIT + " select label, split, count(*) as n from s group by 1, 2",
    "split_disjoint": "select row_id from split_rows where split = 'train' intersect select row_id from split_rows where split <> 'train'",
    "stratified_sample": _RANKED
    + ", l as (select label, row_number() over (order by label nulls first) - 1 as i, count(*) over () as k from (select distinct label from lab)) select row_id, r.label from r join l on r.label is not distinct from l.label where (select count(*) from lab) <= 200 or rank <= 200 // k + cast(i < 200 % k as integer)",
    "interleave_labels": _RANKED + " select row_id, label, rank as round from r",
    "balanced_slice": _RANKED + f" select row_id, label from r where label in ('{REAL}', '{FAKE}') and rank <= 32",
    "head_n": f"with {_ONE} select row_id, label from lab order by row_id limit 200",
    "task_mix_assign": f"""with {_ONE}, u as (select row_id, cast(('0x' || substr(md5('{SEED + 1000003}:' || row_id), 1, 8))::bigint as double) / 4294967296 as x from lab)
select row_id, case when x < 0.40 then 'final_json' when x < 0.75 then 'evidence_trace' when x < 0.90 then 'taxonomy_classification' else 'consistency_check' end as task from u""",
    "semi_split_filter": f"with {_ONE} select * from lab where row_id in (select row_id from split_rows where split = 'eval')",
    "anti_missing": f"with {_ONE} select row_id from lab where not exists (select 1 from split_rows s where s.row_id = lab.row_id)",
    "positional_join": f"with {_ONE}, q as (select line_no, min(query) as query from source_records group by 1) select row_id, label, query, query is null as missing from lab left join q on line_no = row_id",
    "shuffle_rotate": _RANKED + " select a.row_id, b.row_id as next_row from r a join r b on a.label is not distinct from b.label and b.rank = case when a.rank = a.n then 1 else a.rank + 1 end",
}
