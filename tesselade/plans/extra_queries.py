"""Queries of traces, fixed-length tokens and probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselade.dims import CRITERIA, DEFAULT_EVIDENCE, FAKE, NEGATIVE_IN_TARGETS
from tesselade.functions import text as X
from tesselade.functions.clip_tokens import clip_tokens
from tesselade.functions.jsonscan import repaired_json
from tesselade.functions.traces import TRACE, normal_trace_json
from tesselade.operators import derive, metrics, splits
from tesselade.plans.eval_queries import _GOLD, _PRED, _gold, _predictions
from tesselade.plans.target_queries import SEED, _labels
from tesselade.plans.review_queries import _EDGED, _SRC, _any, _pieces
from tesselade.plans.text_queries import ORIGIN, sql_canonical, sql_key, sql_member, sql_sentences
from tesselade.operators.ranking import shuffled
from tesselade.operators.review import source_rows
from tesselade.session import first_delivery, table


def trace_payloads(spark, sf_dir):
    """Raw model texts read as traces: label and positive entries."""
    rows = table(spark, sf_dir, "predictions").where("final_json_text is not null").select("row_id", "prediction_source", normal_trace_json(repaired_json("final_json_text")).alias("json"))
    rows = rows.withColumn("t", F.from_json("json", TRACE))
    return rows.select("row_id", "prediction_source", "t.overall_likelihood", F.size(F.filter("t.per_criterion", lambda e: e["score"] == 1)).alias("positives"))


def clip_token_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", clip_tokens(F.col("text")).alias("ids"))


def probe_report(spark, sf_dir):
    """Accuracy of the student, and of its label for the next row in a shuffled order."""
    rows = _predictions(spark, sf_dir).where("prediction_source = 'student'").groupBy("row_id").agg(F.min("final_json.overall_likelihood").alias("said"))
    gold = _gold(spark, sf_dir).select("row_id", F.col("gold.overall_likelihood").alias("gold"))
    rows = shuffled(rows.join(gold, "row_id"), [], "row_id", SEED)
    n = rows.agg(F.count("*")).scalar()
    turned = rows.select((F.col("rank") % n + 1).alias("turn"), F.col("said").alias("next"))
    found = metrics.probe_accuracies(rows.join(turned, F.col("rank") == F.col("turn")), "gold", {"plain": "said", "shuffled": "next"})
    return found.select("samples", *[F.round(c, 9).alias(c) for c in found.columns[1:]])


def derived_build(spark, sf_dir):
    """The derived table itself, from teacher rows; the key is a hash of the content."""
    rows = table(spark, sf_dir, "teacher_rows").distinct()
    built = derive.derived_rows(rows, F.xxhash64(*rows.columns))
    return built.select("row_id", "image", "final_json_target", "evidence_trace_target", "taxonomy_target", "consistency_target", "quality_flags")


def label_drift(spark, sf_dir):
    """Split shares by label: stored splits against the labels now."""
    stored = table(spark, sf_dir, "split_rows").select("row_id", "split").distinct()
    return _labels(spark, sf_dir).join(stored, "row_id").groupBy("label", "split").agg(F.count("*").alias("n"))


def derived_filelist(spark, sf_dir):
    """(path, label) of the rows of the evaluation split, for an image scorer."""
    held = table(spark, sf_dir, "split_rows").where("split = 'eval'").select("row_id")
    rows = first_delivery(table(spark, sf_dir, "derived"), "row_id", ["image", "image_root", F.col("final_json_target.overall_likelihood").alias("label")], "ingested_at")
    rows = splits.select_rows(rows, "row_id", split=held)
    return rows.select("row_id", X.resolve_path(F.col("image"), F.col("image_root"), "/data").alias("path"), F.col("label").eqNullSafe(FAKE).cast("int").alias("label"))


def binary_label_summary(spark, sf_dir):
    """Rows of either class, zero-filled."""
    return derived_filelist(spark, sf_dir).agg(F.count_if(F.col("label") == 0).alias("real"), F.count_if(F.col("label") == 1).alias("fake"))


def missing_images(spark, sf_dir):
    """Source members that no derived image stands for."""
    members = source_rows(table(spark, sf_dir, "source_records")).where("member is not null").select("line_no", "member").distinct()
    key = lambda c: F.regexp_replace(X.image_member(c), "^images/", "")
    known = table(spark, sf_dir, "derived").where("image is not null").select(key(F.col("image")).alias("k"))
    return members.join(known, key(F.col("member")) == F.col("k"), "left_anti")


def origin_surface(spark, sf_dir):
    """The explanation surface straight from the response, a line a criterion.

    A section of its own, else the first sentence with an alias of the
    criterion, else the default; a positive needs a fake label and evidence
    without a word of absence.
    """
    rows = source_rows(table(spark, sf_dir, "source_records")).where("label is not null").groupBy("line_no").agg(F.min("label").alias("label"), F.min("response").alias("response"))
    named = F.transform(X.sections(F.col("response"), anywhere=True), lambda s: F.struct(X.canonical(s["name"], ORIGIN, X.lookup_key).alias("criterion"), s["body"].alias("body")))
    low = F.lower(X.clean_text(F.col("response")))
    held = F.array_compact(F.array(*[F.when(X.holds_alias(low, a), F.struct(F.lit(c).alias("criterion"), F.lit(a).alias("alias"), F.lit(X.alias_pattern(a)).alias("pattern"))) for a, c in ORIGIN.items()]))
    rows = rows.select("line_no", "label", named.alias("s"), held.alias("a"), X.sentences(F.col("response")).alias("t"))
    rows = rows.select("*", F.posexplode(F.array(*map(F.lit, CRITERIA))).alias("idx", "criterion"))
    own = lambda x: x["criterion"] == F.col("criterion")
    rows = rows.select("line_no", "label", "idx", "criterion", "t", F.try_element_at(F.filter("s", own), F.lit(1))["body"].alias("body"), F.try_element_at(F.filter("a", own), F.lit(1)).alias("alias"))
    around = F.try_element_at(F.filter("t", lambda x: F.regexp_like(F.lower(x), F.col("alias.pattern"))), F.lit(1))
    implied = F.when(F.col("alias").isNotNull(), F.coalesce(around, F.col("alias.alias")))
    rows = rows.select("line_no", "label", "idx", "criterion", F.coalesce("body", implied, F.lit(DEFAULT_EVIDENCE)).alias("evidence"))
    score = (F.col("label") == FAKE) & (F.col("evidence") != DEFAULT_EVIDENCE) & ~X.any_of(F.lower("evidence"), NEGATIVE_IN_TARGETS)
    return rows.select("line_no", "idx", F.concat("criterion", F.lit(" | score="), score.cast("int").cast("string"), F.lit(" | evidence="), "evidence").alias("line"))


def task_targets(spark, sf_dir):
    """One training task a row with its target text."""
    fields = ["final_json_target", "evidence_trace_target", "taxonomy_target", "consistency_target"]
    rows = first_delivery(table(spark, sf_dir, "derived"), "row_id", fields, "ingested_at").withColumn("task", splits.task_pick(F.col("row_id"), SEED, 1))
    return rows.select("row_id", "task", derive.task_target(F.col("task"), *map(F.col, fields)).alias("target"))


QUERIES = {n: globals()[n] for n in ("trace_payloads", "clip_token_ids", "probe_report", "derived_build", "label_drift", "derived_filelist", "binary_label_summary", "missing_images", "origin_surface", "task_targets")}
_FILES = f"""with one as (select row_id, image, image_root, final_json_target.overall_likelihood as l from derived where row_id is not null qualify row_number() over (partition by row_id order by ingested_at nulls last) = 1),
f as (select row_id, case when image like '/%' then image else concat_ws('/', coalesce(image_root, '/data'), image) end as path, cast(coalesce(l, '') = '{FAKE}' as integer) as label from one where row_id in (select row_id from split_rows where split = 'eval'))
"""
_OAL = "al(o, alias, criterion) as (values " + ", ".join(f"({i}, '{a}', '{c}')" for i, (a, c) in enumerate(ORIGIN.items())) + "),"
_OCRIT = "crit(idx, criterion) as (values " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(CRITERIA)) + "),"
_KEY = lambda x: f"regexp_replace({sql_member(x)}, '^images/', '')"
_SHARE = lambda n: f"round(coalesce({n} / nullif(count(*), 0)::double, 0), 9)"
ORACLE = {
    "probe_report": f"""with {_GOLD}, {_PRED}, s as (select row_id, min(j.overall_likelihood) as said from pd where prediction_source = 'student' group by 1),
r as (select said, g.overall_likelihood as gold, row_number() over (order by md5('{SEED}:' || s.row_id), s.row_id) as rank, count(*) over () as n from s join gold on gold.row_id = s.row_id),
x as (select a.said, a.gold, b.said as nxt from r a join r b on a.rank = b.rank % b.n + 1)
select count(*) as samples, {_SHARE('count(said)')} as plain_parse_rate, {_SHARE('count(*) filter (where said = gold)')} as plain_accuracy, {_SHARE('count(nxt)')} as shuffled_parse_rate, {_SHARE('count(*) filter (where nxt = gold)')} as shuffled_accuracy from x""",
    "derived_filelist": _FILES + "select * from f",
    "binary_label_summary": _FILES + "select count(*) filter (where label = 0) as real, count(*) filter (where label = 1) as fake from f",
    "missing_images": f"with m as (select distinct line_no, {sql_member('images[1]')} as member from source_records) select line_no, member from m where member is not null and not exists (select 1 from derived where image is not null and {_KEY('image')} = regexp_replace({sql_member('member')}, '^images/', ''))",
    "origin_surface": "with " + _SRC + _OCRIT + _OAL + _pieces("sec", "chr(10) || response")
    + f"""ex as (select line_no, criterion, arg_min(body, n) as body from (select line_no, n, {sql_canonical('name', ORIGIN, sql_key)} as criterion, body from sec) where criterion is not null group by 1, 2),
hit as (select line_no, criterion, arg_min(alias, o) as alias from src, al where label is not null and regexp_matches(lower(response), {_EDGED}) group by 1, 2),
said as (select h.line_no, h.criterion, coalesce(list_filter({sql_sentences('response')}, lambda q: regexp_matches(lower(q), '(^|[^\\pL\\pN_])' || h.alias || '($|[^\\pL\\pN_])'))[1], alias) as s from hit h join src on src.line_no = h.line_no),
e as (select s.line_no, label, idx, c.criterion, coalesce(body, i.s, '{DEFAULT_EVIDENCE}') as evidence from src s cross join crit c left join ex on ex.line_no = s.line_no and ex.criterion = c.criterion left join said i on i.line_no = s.line_no and i.criterion = c.criterion where label is not null)
select line_no, idx, criterion || ' | score=' || cast(label = '{FAKE}' and evidence <> '{DEFAULT_EVIDENCE}' and not {_any('lower(evidence)', NEGATIVE_IN_TARGETS)} as integer) || ' | evidence=' || evidence as line from e""",
    "label_drift": "with l as (select row_id, final_json_target.overall_likelihood as label from derived where row_id is not null qualify row_number() over (partition by row_id order by ingested_at nulls last) = 1) select label, split, count(*) as n from l join (select distinct row_id, split from split_rows) s using (row_id) group by 1, 2",
}
