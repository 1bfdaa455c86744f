"""Queries of the anchor, draft, review and score chain."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tesselade.dims import ANCHOR_ALIASES, ARTIFACT, CRITERIA, DEFAULT_EVIDENCE, FAKE, NEGATIVE_IN_DRAFTS, REAL, lookup
from tesselade.functions import text as X
from tesselade.operators.review import KEYS, anchored, finalize, given_drafts, heuristic_drafts, judge, judge_input, known_criterion, normal_drafts, reviewed, source_rows, step1_points
from tesselade.plans.text_queries import ORIGIN, B, sql_canonical, sql_clean, sql_compact, sql_evidence, sql_key, sql_label, sql_member, sql_segment, sql_sentences, sql_words
from tesselade.session import table


def _sources(spark, sf_dir):
    return source_rows(table(spark, sf_dir, "source_records"))


def _distinct(spark, sf_dir):
    """One row a line: repeated records count once."""
    return _sources(spark, sf_dir).groupBy("line_no").agg(*[F.min(c).alias(c) for c in ("member", "query", "response", "label")])


def section_extract(spark, sf_dir):
    rows = _distinct(spark, sf_dir).select("line_no", F.posexplode(X.sections(F.col("response"))).alias("pos", "s"))
    return rows.select("line_no", "pos", F.col("s.name").alias("name"), known_criterion(F.col("s.name")).alias("criterion"), F.col("s.body").alias("body"))


def section_first_wins(spark, sf_dir):
    found = _distinct(spark, sf_dir).select("line_no", F.posexplode(X.sections(F.col("response"), anywhere=True)).alias("pos", "s"))
    found = found.select("line_no", "pos", X.canonical(F.col("s.name"), ORIGIN, X.lookup_key).alias("criterion"), F.col("s.body").alias("body")).where("criterion is not null")
    return found.groupBy("line_no", "criterion").agg(F.min_by("body", "pos").alias("body"))


def description_extract(spark, sf_dir):
    return _distinct(spark, sf_dir).select("line_no", X.description(F.col("response")).alias("description"))


KEY = ["line_no"]


def _labelled(spark, sf_dir):
    return _distinct(spark, sf_dir).where("label is not null").select("line_no", "label", "response")


def _raw(spark, sf_dir):
    return heuristic_drafts(anchored(_labelled(spark, sf_dir)))


def _normal(spark, sf_dir):
    return normal_drafts(_raw(spark, sf_dir).withColumns({"anchor_kind": F.col("support_type"), "anchor_span": F.col("holmes_span"), "given": F.lit(True)}))


def _judged(spark, sf_dir):
    return judge(_normal(spark, sf_dir), KEY)


def _final(spark, sf_dir):
    return reviewed(_labelled(spark, sf_dir), KEY)


def _entries(build, *fields):
    return lambda spark, sf_dir: build(spark, sf_dir).select("line_no", "idx", *fields)


def step1_target(spark, sf_dir):
    described = _labelled(spark, sf_dir).select("line_no", X.description(F.col("response")).alias("description"))
    return step1_points(_raw(spark, sf_dir), described, "line_no")


def official_scores(spark, sf_dir):
    """The exported view: label, and score and evidence of each criterion."""
    return _final(spark, sf_dir).select("line_no", "label", "idx", "criterion", F.col("final_score").alias("score"), F.col("exported_evidence").alias("evidence"))


def pipeline_counters(spark, sf_dir):
    """Totals of the named counters."""
    return _final(spark, sf_dir).select(F.explode(F.concat("counters", "final_counters")).alias("counter")).groupBy("counter").agg(F.count("*").alias("n"))


def unlabelled_sources(spark, sf_dir):
    """Records that no label can be derived for, kept apart."""
    return _distinct(spark, sf_dir).where("label is null").select("line_no", "member")


def reviewed_drafts(spark, sf_dir):
    """The review-only path over teacher drafts."""
    stated = F.col("step2_draft.overall_likelihood")
    image = F.col("image")
    label = F.when(stated.isin(REAL, FAKE), stated).when(image.contains("/0_real/") | image.startswith("images/0_real/"), REAL).otherwise(FAKE)
    rows = table(spark, sf_dir, "teacher_rows").where("step2_draft is not null").distinct()
    rows = rows.select(F.xxhash64("image", "source", "original_query", "original_response", "step1_target", "step2_draft").alias("key"), label.alias("label"), F.col("step2_draft.per_criterion_draft").alias("drafts"))
    final = finalize(judge(judge_input(given_drafts(rows, "drafts")), ["key"]), ["key"])
    return final.groupBy("criterion", "judge_verdict", "recommended_score", "specialist_used", "final_score").agg(F.count("*").alias("n"))


QUERIES = {
    "section_extract": section_extract,
    "section_first_wins": section_first_wins,
    "description_extract": description_extract,
    "anchor_support": _entries(lambda s, d: anchored(_labelled(s, d)), "criterion", "support_type", "holmes_span"),
    "heuristic_draft": _entries(_raw, "criterion", "proposed_score", "evidence", "support_type", "holmes_span"),
    "normal_draft": _entries(_normal, "criterion", "proposed_score", "evidence", "support_type", "holmes_span", "artifact_score_conflict", "non_applicable"),
    "judge_review": _entries(_judged, "criterion", "verdict", "reason", "score_consistency", "recommended_score"),
    "finalize_scores": _entries(_final, "criterion", "proposed_score", "evidence", "support_type", "holmes_span", "judge_verdict", "judge_reason", "recommended_score", "specialist_used", "final_score"),
    "step1_target": step1_target,
    "official_scores": official_scores,
    "pipeline_counters": pipeline_counters,
    "unlabelled_sources": unlabelled_sources,
    "reviewed_drafts": reviewed_drafts,
}

_D = f"'{DEFAULT_EVIDENCE}'"
_ENDS = f"'^{B}+|{B}+$'"
_SRC = f"""src0 as (select line_no, {sql_member('images[1]')} as member, regexp_replace(coalesce(response, ''), {_ENDS}, '', 'g') as response from source_records),
src as (select line_no, min(member) as member, min(response) as response, {sql_label('min(member)')} as label from src0 group by line_no),
"""
_HEAD = f"\\n{B}*[0-9]+\\.{B}+\\*\\*"


def _pieces(name, source):
    return f"""{name}0 as (select line_no, unnest(a[2:]) as p, unnest(range(len(a) - 1)) as n from (select line_no, regexp_split_to_array({source}, '{_HEAD}') as a from src)),
{name} as (select line_no, n, substr(p, 1, strpos(p, '**:') - 1) as name, {sql_clean("substr(p, strpos(p, '**:') + 3)")} as body from {name}0 where strpos(p, '**:') > 0 and {sql_clean("substr(p, strpos(p, '**:') + 3)")} <> ''),
"""


_CRIT = "crit(idx, criterion) as (values " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(CRITERIA)) + "),\n"
_ALIAS = "al(o, alias, criterion) as (values " + ", ".join(f"({i}, '{a}', '{c}')" for i, (a, c) in enumerate(lookup(ANCHOR_ALIASES).items())) + "),\n"
_KNOWN = sql_canonical("name", KEYS, lambda x: f"lower({sql_clean(x)})")
_EDGED = "'(^|[^\\pL\\pN_])' || alias || '($|[^\\pL\\pN_])'"


def _any(x, markers):
    pattern = "|".join(map(re.escape, markers)).replace("\\ ", " ").replace("\\-", "-").replace("'", "''")
    return f"regexp_matches({x}, '{pattern}')"


def _clip(x, n):
    return sql_compact(x, n, sql_clean(x))


def _wc(x):
    return f"len({sql_words(x)})"


_CHAIN = (
    "with "
    + _SRC
    + _CRIT
    + _ALIAS
    + _pieces("sec", "response")
    + f"""ex as (select line_no, criterion, arg_min(body, n) as body from (select line_no, n, {_KNOWN} as criterion, body from sec) where criterion is not null group by 1, 2),
hit as (select line_no, criterion, arg_min(alias, o) as alias from src, al where label is not null and regexp_matches(lower(response), {_EDGED}) group by 1, 2),
said as (select h.line_no, h.criterion, coalesce(list_filter({sql_sentences('response')}, lambda q: regexp_matches(lower(q), '(^|[^\\pL\\pN_])' || h.alias || '($|[^\\pL\\pN_])'))[1], alias) as s from hit h join src on src.line_no = h.line_no),
anc as (select s.line_no, s.label, idx, c.criterion, case when body is not null then 'explicit_holmes' when i.s is not null then 'implied_holmes' else 'unsupported' end as support_type,
 case when coalesce(body, i.s) is null then '' else {sql_evidence('coalesce(body, i.s)')} end as holmes_span
 from src s cross join crit c left join ex on ex.line_no = s.line_no and ex.criterion = c.criterion left join said i on i.line_no = s.line_no and i.criterion = c.criterion where s.label is not null),
raw as (select *, cast(holmes_span <> '' and label = '{FAKE}' and support_type <> 'unsupported' as integer) as proposed_score, case when holmes_span <> '' then {sql_evidence('holmes_span')} else {_D} end as evidence from anc),
n1 as (select line_no, label, idx, criterion, support_type, proposed_score as p0, case when support_type = 'unsupported' then '' else {sql_evidence('holmes_span', 32)} end as holmes_span, {sql_evidence('evidence')} as e0 from raw),
n2 as (select *, case when support_type = 'unsupported' then {_D} when support_type = 'implied_holmes' and {_wc('e0')} < 4 then {sql_evidence('holmes_span')} else e0 end as evidence from n1),
n3 as (select *, {_any('lower(evidence)', NEGATIVE_IN_DRAFTS)} or support_type = 'unsupported' as non_applicable, support_type <> 'unsupported' as h, {_any("lower(concat_ws(' ', evidence, holmes_span))", NEGATIVE_IN_DRAFTS)} as no from n2),
dra as (select *, case when non_applicable then 0 else p0 end as proposed_score, (label = '{FAKE}' and h and not no and case when non_applicable then 0 else p0 end = 0) as artifact_score_conflict from n3),
j1 as (select *, case when proposed_score = 0 then 'accept' when label = '{REAL}' then 'downgrade_to_0' when support_type = 'explicit_holmes' then 'accept' when holmes_span <> '' then 'accept' else 'downgrade_to_0' end as v,
 case when proposed_score = 0 then 'Negative or neutral entry kept as non-positive evidence.' when label = '{REAL}' then 'Real samples do not allow positive AIGC criteria.' when support_type = 'explicit_holmes' then 'Directly supported by Holmes wording.'
 when holmes_span <> '' then 'Holmes wording strongly implies this criterion.' else 'Implied support is too weak.' end as r,
 lower(case when {sql_clean('holmes_span')} <> '' then {sql_clean('holmes_span')} else {sql_clean('evidence')} end) as k from dra),
j2 as (select *, case when artifact_score_conflict then 'inconsistent' else 'consistent' end as c, case when artifact_score_conflict then case when label = '{FAKE}' and h and v = 'accept' then 'set_to_1' else 'set_to_0' end else 'keep' end as a,
 proposed_score = 1 and v = 'accept' and k <> '' as counts from j1),
rev as (select *, counts and row_number() over (partition by line_no, counts, k order by idx) > 1 as again from j2),
jud as (select *, case when again then 'downgrade_to_0' else v end as verdict, case when again then 'Redundant with another accepted positive criterion.' else r end as reason,
 case when again then 'inconsistent' else c end as score_consistency, case when again then 'set_to_0' else a end as recommended_score from rev),
f0 as (select line_no, label, idx, criterion, support_type, h, proposed_score, verdict, reason, recommended_score, {_clip('holmes_span', 30)} as holmes_span, {_clip('evidence', 25)} as e from jud),
f1 as (select *, label = '{FAKE}' and h and not {_any("lower(concat_ws(' ', e, holmes_span))", NEGATIVE_IN_DRAFTS)} as pos from f0),
f2 as (select *, label = '{FAKE}' and recommended_score <> 'set_to_0' and verdict = 'accept' and (proposed_score = 1 or pos) and h and not {_any('lower(e)', NEGATIVE_IN_DRAFTS)} as f,
 lower(case when {sql_clean('holmes_span')} <> '' then {sql_clean('holmes_span')} else {sql_clean('e')} end) as k from f1),
f3 as (select *, f and k <> '' and row_number() over (partition by line_no, f, k order by idx) > 1 as twice from f2),
f4 as (select *, f and not twice as g, case when label = '{FAKE}' then not (f and not twice) and holmes_span = '' and not h else holmes_span = '' and not h end as bare from f3),
f5 as (select *, {sql_evidence(f"case when bare then {_D} else e end")} as evidence, h and holmes_span <> '' as may, bool_or(g) over (partition by line_no) as has from f4),
f6 as (select *, label = '{FAKE}' and not has and may and row_number() over (partition by line_no, may order by idx) = 1 as back from f5),
f7 as (select *, g or back as s0, case when back then 'accept' else verdict end as judge_verdict, case when back then 'Fallback positive restored from Holmes-supported evidence.' when twice then 'Redundant with another accepted positive criterion.' else reason end as judge_reason,
 lower({sql_clean('evidence')}) as le from f6),
f8 as (select *, s0 and {sql_evidence('evidence')} = {_D} as x1, label = '{FAKE}' and judge_verdict = 'accept' and h and le <> '' and le not in (lower({_D}), 'none.') and not {_any('le', NEGATIVE_IN_DRAFTS)} and ({_any('le', ARTIFACT)} or {_wc('evidence')} >= 6) as art from f7),
f9 as (select *, s0 and not x1 and judge_verdict = 'downgrade_to_0' as x2 from f8),
fin as (select *, art and not (s0 and not x1 and not x2) as x3, cast((s0 and not x1 and not x2) or art as integer) as final_score from f9)
"""
)

ORACLE = {
    "section_extract": "with " + _SRC + _pieces("sec", "response") + f"z as (select 1) select line_no, cast(row_number() over (partition by line_no order by n) - 1 as integer) as pos, name, {_KNOWN} as criterion, body from sec",
    "section_first_wins": "with " + _SRC + _pieces("sec", "chr(10) || response") + f"z as (select 1) select line_no, criterion, arg_min(body, n) as body from (select line_no, n, {sql_canonical('name', ORIGIN, sql_key)} as criterion, body from sec) where criterion is not null group by 1, 2",
    "description_extract": "with " + _SRC + f"z as (select 1) select line_no, case when strpos(response, 'Image Description:') = 0 then '' else {sql_clean(f'''regexp_split_to_array(substr(response, strpos(response, 'Image Description:') + 18), '{chr(92)}n{B}*Based on the provided')[1]''')} end as description from src",
    "anchor_support": _CHAIN + "select line_no, idx, criterion, support_type, holmes_span from anc",
    "heuristic_draft": _CHAIN + "select line_no, idx, criterion, proposed_score, evidence, support_type, holmes_span from raw",
    "normal_draft": _CHAIN + "select line_no, idx, criterion, proposed_score, evidence, support_type, holmes_span, artifact_score_conflict, non_applicable from dra",
    "judge_review": _CHAIN + "select line_no, idx, criterion, verdict, reason, score_consistency, recommended_score from jud",
    "finalize_scores": _CHAIN + "select line_no, idx, criterion, proposed_score, evidence, support_type, holmes_span, judge_verdict, judge_reason, recommended_score, false as specialist_used, final_score from fin",
    "step1_target": _CHAIN
    + f""", ds as (select line_no, case when strpos(response, 'Image Description:') = 0 then '' else {sql_clean(f'''regexp_split_to_array(substr(response, strpos(response, 'Image Description:') + 18), '{chr(92)}n{B}*Based on the provided')[1]''')} end as d from src where label is not null),
pts as (select line_no, -1 as idx, {sql_segment('d')} as pt from ds where d <> '' union all select line_no, idx, {sql_segment('evidence')} from raw where holmes_span <> ''),
rk as (select *, row_number() over (partition by line_no order by idx) as rn from pts)
select ds.line_no, 'Key points: ' || coalesce(case when count(rn) = 0 then 'Holmes explanation mapped into canonical criteria with fixed label supervision.' else coalesce(string_agg(case when pt <> '' then pt end, '; ' order by rn), '') end, '') as step1_target
from ds left join rk on rk.line_no = ds.line_no and rn <= 3 group by ds.line_no""",
    "official_scores": _CHAIN + f"select line_no, label, idx, criterion, final_score as score, {sql_evidence('evidence')} as evidence from fin",
    "pipeline_counters": _CHAIN
    + f""", c as (select 'real_supported_zero_count' as counter from fin where label <> '{FAKE}' and (holmes_span <> '' or h) union all select 'redundant_positive_downgrade_count' from fin where twice
 union all select 'judge_downgrade_count' from fin where verdict = 'downgrade_to_0' and proposed_score = 1 union all select 'fake_positive_fallback_count' from fin where back
 union all select 'export_consistency_fix_count' from fin where x1 union all select 'export_consistency_fix_count' from fin where x2 union all select 'export_consistency_fix_count' from fin where x3
 union all select 'official_export_rows' from src where label is not null)
select counter, count(*) as n from c group by 1""",
    "unlabelled_sources": "with " + _SRC + "z as (select 1) select line_no, member from src where label is null",
}
