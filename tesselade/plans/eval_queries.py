"""Queries of predictions, scores, metrics and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesselade.dims import CRITERIA, DEFAULT_EVIDENCE, FAKE, REAL
from tesselade.functions import jsonscan
from tesselade.functions import text as X
from tesselade.operators import derive, metrics
from tesselade.plans.target_queries import _TARGET
from tesselade.plans.text_queries import sql_clean
from tesselade.session import first_delivery, table


def _scores(spark, sf_dir):
    """One score a run and row: the latest scored, then the latest loaded; null scores are left out."""
    rows = table(spark, sf_dir, "detector_scores").where("detector_score is not null and gold_label is not null")
    latest = F.struct(F.coalesce(F.unix_micros("scored_at"), F.lit(0)).alias("a"), F.coalesce(F.unix_micros("loaded_at"), F.lit(0)).alias("b"), "detector_score")
    return rows.groupBy("run_id", "row_id").agg(F.max_by(F.struct("gold_label", "detector_score", "detector_threshold"), latest).alias("s")).select("run_id", "row_id", "s.*")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


RATES = ("accuracy", "macro_f1", "real_recall", "fake_recall", "real_false_positive_rate")


def binary_metrics(spark, sf_dir):
    found = metrics.binary_metrics(_scores(spark, sf_dir), ["run_id"], "gold_label", "detector_score", F.coalesce("detector_threshold", F.lit(0.5)))
    return _rounded(found, *RATES)


def average_precision(spark, sf_dir):
    return _rounded(metrics.average_precision(_scores(spark, sf_dir), ["run_id"], "gold_label", "detector_score", "row_id"), "average_precision")


def threshold_sweep(spark, sf_dir):
    found = metrics.threshold_sweep(_scores(spark, sf_dir), ["run_id"], "gold_label", "detector_score")
    return _rounded(found.select("run_id", "threshold", *metrics.CONFUSION, "accuracy", "macro_f1"), "threshold", "accuracy", "macro_f1")


def best_threshold(spark, sf_dir):
    sweep = _rounded(metrics.threshold_sweep(_scores(spark, sf_dir), ["run_id"], "gold_label", "detector_score"), "macro_f1", "accuracy")
    return metrics.best_threshold(sweep, ["run_id"])


def score_labels(spark, sf_dir):
    """Label of each score at its threshold against the stored label."""
    label = X.label_from_score(F.col("detector_score"), F.col("detector_threshold"))
    return table(spark, sf_dir, "detector_scores").groupBy(F.col("detector_label").alias("stored"), label.alias("label"), "gold_label").agg(F.count("*").alias("n"))


def checkpoint_ranking(spark, sf_dir):
    """Runs of each checkpoint by macro-F1, null last, then run."""
    order = Window.partitionBy("checkpoint_name").orderBy(F.desc_nulls_last("macro_f1"), "run_id")
    runs = table(spark, sf_dir, "detector_runs").select("run_id", "checkpoint_name", "epoch", "macro_f1")
    return runs.withColumn("rank", F.row_number().over(order))


def best_so_far(spark, sf_dir):
    """Whether each epoch of a checkpoint beats all epochs before it."""
    before = Window.partitionBy("checkpoint_name").orderBy("started_at", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    runs = table(spark, sf_dir, "detector_runs")
    return runs.select("run_id", "checkpoint_name", (F.col("macro_f1") > F.coalesce(F.max("macro_f1").over(before), F.lit(-1.0))).alias("improved"))


def _gold(spark, sf_dir):
    return first_delivery(table(spark, sf_dir, "derived"), "row_id", [F.col("final_json_target").alias("gold"), F.col("evidence_trace_target").alias("trace")], "ingested_at")


def _predictions(spark, sf_dir):
    """One prediction a row, source and mode: the latest."""
    rows = table(spark, sf_dir, "predictions").where("row_id is not null")
    content = F.struct("overall_correct", "error_type", "final_json_parse_ok", "trace_parse_ok", "final_json_text", "final_json", "detector")
    at = F.struct(F.coalesce(F.unix_micros("predicted_at"), F.lit(0)).alias("a"), F.xxhash64(content).alias("h"))
    return rows.groupBy("row_id", "prediction_source", "inference_mode").agg(F.max_by(content, at).alias("p")).select("row_id", "prediction_source", "inference_mode", "p.*")


def prediction_errors(spark, sf_dir):
    return table(spark, sf_dir, "predictions").groupBy("prediction_source", "inference_mode", "error_type").agg(F.count("*").alias("n"), F.count_if("overall_correct").alias("correct"), F.count_if("final_json_parse_ok").alias("parsed"))


def error_types(spark, sf_dir):
    """The error class that each stored prediction should have."""
    source, mode = F.col("prediction_source"), F.col("inference_mode")
    parsed, correct = F.coalesce("final_json_parse_ok", F.lit(False)), F.coalesce("overall_correct", F.lit(False))
    mismatch = F.when(~correct, "overall_mismatch").otherwise("ok")
    kind = F.when(source == "detector", mismatch).when(~parsed, "final_json_parse_error").when((mode == "two_stage") & source.isin("student", "detector_student") & ~F.coalesce("trace_parse_ok", F.lit(False)), "trace_json_parse_error").otherwise(mismatch)
    rows = table(spark, sf_dir, "predictions").select("prediction_source", "inference_mode", F.col("error_type").alias("stored"), kind.alias("error_type"))
    return rows.groupBy("prediction_source", "inference_mode", "stored", "error_type").agg(F.count("*").alias("n"))


def overlay_detector(spark, sf_dir):
    """The detector's label put over the predicted one, which is kept beside it."""
    label = F.coalesce("detector.detector_label", "final_json.overall_likelihood")
    rows = table(spark, sf_dir, "predictions")
    return rows.select("row_id", F.col("final_json.overall_likelihood").alias("student_label"), label.alias("overall_likelihood"), "detector.detector_score", "detector.detector_threshold")


def criterion_f1(spark, sf_dir):
    """Precision, recall and F1 of each criterion and source; unparsed predictions add nothing."""
    pred = _predictions(spark, sf_dir).where("final_json is not null").select("row_id", "prediction_source", derive.normal_prediction(F.col("final_json")).alias("p"))
    gold = _gold(spark, sf_dir).where("gold is not null").select("row_id", derive.normal_prediction(F.col("gold")).alias("g"))
    pairs = pred.join(gold, "row_id").select("prediction_source", F.explode(F.arrays_zip(F.col("p.per_criterion").alias("p"), F.col("g.per_criterion").alias("g"))).alias("e"))
    p, g = F.col("e.p.`aigc score`"), F.col("e.g.`aigc score`")
    counts = pairs.groupBy("prediction_source", F.col("e.g.criterion").alias("criterion")).agg(*metrics.confusion(g, p))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("prediction_source", "criterion", "tp", "fp", "fn", F.round(metrics.ratio(tp, tp + fp), 9).alias("precision"), F.round(metrics.ratio(tp, tp + fn), 9).alias("recall"), F.round(metrics.f1(tp, fp, fn), 9).alias("f1"))


def eval_report(spark, sf_dir):
    """One row a source and mode: rates, accuracy, macro-F1, false positives.

    Macro-F1 is 0 where any prediction is missing.
    """
    rows = _predictions(spark, sf_dir).join(_gold(spark, sf_dir).select("row_id", "gold"), "row_id")
    gold, said = F.col("gold.overall_likelihood"), F.col("final_json.overall_likelihood")
    g, p = gold.eqNullSafe(FAKE).cast("int"), F.when(F.col("final_json").isNotNull(), said.eqNullSafe(FAKE).cast("int"))
    found = rows.groupBy("prediction_source", "inference_mode").agg(
        F.count("*").alias("samples"), F.count_if("final_json_parse_ok").alias("parsed"), F.count_if(said == gold).alias("correct"), F.count(p).alias("predicted"),
        F.count_if(gold == REAL).alias("real_samples"), F.count_if((gold == REAL) & (said == FAKE)).alias("real_fp"), *metrics.confusion(g, p),
    )
    tp, tn, fp, fn = map(F.col, metrics.CONFUSION)
    macro = F.when(F.col("predicted") == F.col("samples"), (metrics.f1(tp, fp, fn) + metrics.f1(tn, fn, fp)) / 2).otherwise(0.0)
    r = lambda a, b: F.round(metrics.ratio(F.col(a), F.col(b)), 9)
    return found.select("prediction_source", "inference_mode", "samples", r("parsed", "samples").alias("json_parse_rate"), r("correct", "samples").alias("overall_accuracy"), F.round(macro, 9).alias("overall_macro_f1"), r("real_fp", "real_samples").alias("real_false_positive_rate"))


def trace_accuracy(spark, sf_dir):
    """Support, taxonomy and consistency agreement of teacher drafts with the derived traces."""
    rows = table(spark, sf_dir, "teacher_rows").select("image", "step2_internal", "step2_draft")
    pred = derive.step2_source(rows).where("entries is not null").select(X.image_member(F.col("image")).alias("member"), derive.trace(F.col("entries")).alias("p"))
    pred = pred.groupBy("member").agg(F.min("p").alias("p"))
    gold = first_delivery(table(spark, sf_dir, "derived"), "row_id", ["image", F.col("evidence_trace_target.per_criterion").alias("g")], "ingested_at")
    gold = gold.where("g is not null").select("row_id", X.image_member(F.col("image")).alias("member"), F.explode("g").alias("g")).where("g is not null")
    mine = F.try_element_at(F.filter("p", lambda e: e["criterion"] == F.col("g.criterion")), F.lit(1))
    pairs = gold.join(pred, "member").select("g", mine.alias("m"))
    fine = (F.coalesce("m.score", F.lit(0)) == 0) | ((F.col("m.evidence") != "") & (F.col("m.support_type") != "unsupported"))
    same = lambda f: F.count_if(F.col(f"m.{f}").eqNullSafe(F.col(f"g.{f}")))
    return pairs.agg(
        F.count("*").alias("total"), same("support_type").alias("support_correct"), same("artifact_taxonomy").alias("taxonomy_correct"), F.count_if(fine == ~F.coalesce("g.artifact_score_conflict", F.lit(False))).alias("consistency_correct"),
    )


def explanation_surface(spark, sf_dir):
    rows = _predictions(spark, sf_dir).where("final_json is not null")
    return rows.select("row_id", "prediction_source", "inference_mode", derive.explanation_surface(derive.normal_prediction(F.col("final_json"))).alias("surface"))


def _surfaces(spark, sf_dir):
    """Tokens of the gold (r) and the predicted surface (h) of each prediction.

    Both tables grow, and the planner takes their texts and token arrays for far
    smaller than they are: the join is never broadcast, and only pairs are tokenized.
    """
    gold = _gold(spark, sf_dir).where("gold is not null").select("row_id", derive.explanation_surface(derive.normal_prediction(F.col("gold"))).alias("gold"))
    pairs = explanation_surface(spark, sf_dir).join(gold.hint("merge"), "row_id")
    return pairs.select("row_id", "prediction_source", "inference_mode", X.tokens(F.col("gold")).alias("r"), X.tokens(F.col("surface")).alias("h"))


def _text(field):
    def run(spark, sf_dir):
        return _surfaces(spark, sf_dir).select("row_id", "prediction_source", "inference_mode", F.round(metrics.text_scores("r", "h")[field], 6).alias(field))

    return run


def explanatory_metrics(spark, sf_dir):
    rows = _surfaces(spark, sf_dir).select("prediction_source", metrics.text_scores("r", "h").alias("s"))
    return rows.groupBy("prediction_source").agg(F.count("*").alias("n"), *[F.round(F.avg(f"s.{f}"), 6).alias(f) for f in ("bleu_1", "rouge_l", "meteor")])


def json_parse_predictions(spark, sf_dir):
    """Whether the raw text holds one JSON value that parses."""
    rows = table(spark, sf_dir, "predictions").select("row_id", "prediction_source", F.col("final_json_parse_ok").alias("stored"), (F.col("final_json_text").isNotNull()).alias("given"), jsonscan.json_value("final_json_text").alias("json"))
    return rows.groupBy("prediction_source", "given", "stored", F.col("json").isNotNull().alias("parses")).agg(F.count("*").alias("n"))


def json_repair_ladder(spark, sf_dir):
    """The repaired JSON of every raw text with its label."""
    rows = table(spark, sf_dir, "predictions").where("final_json_text is not null").select("row_id", "prediction_source", jsonscan.repaired_json("final_json_text").alias("json"))
    return rows.select("row_id", "prediction_source", F.get_json_object("json", "$.overall_likelihood").alias("label"), F.col("json").isNotNull().alias("parses"))


def json_parse_events(spark, sf_dir):
    payload = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(payload, "$.k", "int").alias("k"))


def embedding_linear_score(spark, sf_dir):
    """A fixed linear head over the feature vectors: the scorer's stand-in."""
    weights = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: ((i * 37) % 101 - 50) / F.lit(100.0))
    dot = F.aggregate(F.zip_with(F.transform("embedding", lambda x: x.cast("double")), weights, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(1 / (1 + F.exp(-dot)), 6).alias("score"))


_NAMES = (
    "binary_metrics average_precision threshold_sweep best_threshold score_labels checkpoint_ranking best_so_far prediction_errors error_types overlay_detector criterion_f1 eval_report trace_accuracy explanation_surface "
    "explanatory_metrics json_parse_predictions json_repair_ladder json_parse_events embedding_linear_score"
).split()
QUERIES = {n: globals()[n] for n in _NAMES} | {"bleu1_pairs": _text("bleu_1"), "rouge_l_pairs": _text("rouge_l"), "meteor_pairs": _text("meteor")}


def _r(a, b):
    return f"round(coalesce(cast({a} as double) / nullif({b}, 0), 0), 9)"


def _f(tp, fp, fn):
    return f"coalesce(2.0::double * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0)"


_S = "s as (select run_id, row_id, gold_label, detector_score, detector_threshold from detector_scores where detector_score is not null and gold_label is not null qualify row_number() over (partition by run_id, row_id order by coalesce(epoch_us(scored_at), 0) desc, coalesce(epoch_us(loaded_at), 0) desc, detector_score desc) = 1)"
_COUNT = lambda g, p: f"count(*) filter (where {g} = 1 and {p} = 1) as tp, count(*) filter (where {g} = 0 and {p} = 0) as tn, count(*) filter (where {g} = 0 and {p} = 1) as fp, count(*) filter (where {g} = 1 and {p} = 0) as fn"
_ACC = f"{_r('tp + tn', 'tp + tn + fp + fn')} as accuracy, round(({_f('tp', 'fp', 'fn')} + {_f('tn', 'fn', 'fp')}) / 2, 9) as macro_f1"
_SWEEP = f"with {_S}, t as (select unnest(range(5, 96)) as step), c as (select run_id, step, {_COUNT('gold_label', 'cast(detector_score >= step / 100.0::double as integer)')} from s, t group by 1, 2), m as (select run_id, round(step / 100.0::double, 9) as threshold, tp, tn, fp, fn, {_ACC} from c)"
_GOLD = "gold as (select row_id, final_json_target as g from derived where row_id is not null qualify row_number() over (partition by row_id order by ingested_at nulls last) = 1)"
_EIGHT = "crit(idx, criterion) as (values " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(CRITERIA)) + ")"
_PRED = "pr as (select *, row_number() over () as k from predictions where row_id is not null), pd as (select row_id, prediction_source, inference_mode, final_json_parse_ok, final_json as j from pr qualify row_number() over (partition by row_id, prediction_source, inference_mode order by coalesce(epoch_us(predicted_at), 0) desc, k) = 1)"


def _normal(name, source, key, field):
    """Long form of a normalised payload: key, idx, criterion, score, evidence."""
    return f"""{name}0 as (select {key}, n, {_TARGET} as criterion, e.evidence as ev, cast(coalesce(e."aigc score", 0) <> 0 as integer) as sc from (select {key}, unnest({field}.per_criterion) as e, unnest(range(len({field}.per_criterion))) as n from {source} where {field} is not null) where e is not null),
{name}1 as (select * from {name}0 qualify row_number() over (partition by {key}, criterion order by n) = 1),
{name} as (select {', '.join('b.' + k.strip() for k in key.split(','))}, idx, crit.criterion, coalesce(sc, 0) as score, case when {sql_clean('ev')} = '' then '{DEFAULT_EVIDENCE}' else {sql_clean('ev')} end as evidence from (select distinct {key} from {source} where {field} is not null) b cross join crit left join {name}1 f on {' and '.join(f'f.{k.strip()} = b.{k.strip()}' for k in key.split(','))} and f.criterion = crit.criterion)"""


_PKEY = "row_id, prediction_source, inference_mode"
_SURF = lambda name, key: f"{name}s as (select {key}, string_agg(criterion || ' | score=' || score || ' | evidence=' || evidence, chr(10) order by idx) || chr(10) || 'overall_likelihood | ' || case when max(score) = 1 then '{FAKE}' else '{REAL}' end as surface from {name} group by {key})"
_BOTH = f"with {_EIGHT}, {_GOLD}, {_PRED}, {_normal('np', 'pd', _PKEY, 'j')}, {_normal('ng', 'gold', 'row_id', 'g')}, {_SURF('np', _PKEY)}, {_SURF('ng', 'row_id')}"


def _tok(x):
    return f"regexp_extract_all(lower({sql_clean(x)}), '[\\pL\\pN_]+|[^\\pL\\pN_ ]')"


_PAIRS = _BOTH + f", pt as (select p.row_id, prediction_source, inference_mode, {_tok('g.surface')} as r, {_tok('p.surface')} as h from nps p join ngs g on g.row_id = p.row_id)"
_SIDE = lambda x: f"select {_PKEY}, unnest({x}) as tok, unnest(range(len({x}))) as pos from pt"

ORACLE = {
    "binary_metrics": f"with {_S}, c as (select run_id, {_COUNT('gold_label', 'cast(detector_score >= coalesce(detector_threshold, 0.5) as integer)')} from s group by 1) select run_id, tp, tn, fp, fn, {_ACC}, {_r('tn', 'tn + fp')} as real_recall, {_r('tp', 'tp + fn')} as fake_recall, {_r('fp', 'tn + fp')} as real_false_positive_rate, tp + fp as pred_fake_count, tn + fn as pred_real_count from c",
    "average_precision": f"with {_S}, r as (select run_id, gold_label, row_number() over w as rk, sum(gold_label) over (partition by run_id order by detector_score desc, row_id rows unbounded preceding) as p from s window w as (partition by run_id order by detector_score desc, row_id)) select run_id, {_r('sum(case when gold_label = 1 then p / rk::double end)', 'sum(gold_label)')} as average_precision from r group by 1",
    "threshold_sweep": _SWEEP + " select run_id, threshold, tp, tn, fp, fn, accuracy, macro_f1 from m",
    "best_threshold": _SWEEP + " select run_id, threshold, macro_f1, accuracy, tp, tn, fp, fn from m qualify row_number() over (partition by run_id order by macro_f1 desc, accuracy desc, abs(threshold - 0.5), threshold) = 1",
    "score_labels": f"select detector_label as stored, case when detector_score >= detector_threshold then '{FAKE}' when detector_score < detector_threshold then '{REAL}' end as label, gold_label, count(*) as n from detector_scores group by 1, 2, 3",
    "checkpoint_ranking": "select run_id, checkpoint_name, epoch, macro_f1, cast(row_number() over (partition by checkpoint_name order by macro_f1 desc nulls last, run_id) as integer) as rank from detector_runs",
    "best_so_far": "select run_id, checkpoint_name, macro_f1 > coalesce(max(macro_f1) over (partition by checkpoint_name order by started_at, run_id rows between unbounded preceding and 1 preceding), -1) as improved from detector_runs",
    "prediction_errors": "select prediction_source, inference_mode, error_type, count(*) as n, count(*) filter (where overall_correct) as correct, count(*) filter (where final_json_parse_ok) as parsed from predictions group by 1, 2, 3",
    "error_types": """select prediction_source, inference_mode, error_type as stored, case when prediction_source = 'detector' then case when coalesce(overall_correct, false) then 'ok' else 'overall_mismatch' end when not coalesce(final_json_parse_ok, false) then 'final_json_parse_error'
 when inference_mode = 'two_stage' and prediction_source in ('student', 'detector_student') and not coalesce(trace_parse_ok, false) then 'trace_json_parse_error' when coalesce(overall_correct, false) then 'ok' else 'overall_mismatch' end as error_type, count(*) as n from predictions group by 1, 2, 3, 4""",
    "overlay_detector": "select row_id, final_json.overall_likelihood as student_label, coalesce(detector.detector_label, final_json.overall_likelihood) as overall_likelihood, detector.detector_score as detector_score, detector.detector_threshold as detector_threshold from predictions",
    "criterion_f1": _BOTH + f", c as (select prediction_source, g.criterion, {_COUNT('g.score', 'p.score')} from np p join ng g on g.row_id = p.row_id and g.idx = p.idx group by 1, 2) select prediction_source, criterion, tp, fp, fn, {_r('tp', 'tp + fp')} as precision, {_r('tp', 'tp + fn')} as recall, round({_f('tp', 'fp', 'fn')}, 9) as f1 from c",
    "eval_report": f"""with {_GOLD}, {_PRED}, x as (select prediction_source, inference_mode, final_json_parse_ok as ok, g.overall_likelihood as gl, j.overall_likelihood as pl, cast(coalesce(g.overall_likelihood, '') = '{FAKE}' as integer) as gb, case when j is not null then cast(coalesce(j.overall_likelihood, '') = '{FAKE}' as integer) end as pb from pd join gold on gold.row_id = pd.row_id),
c as (select prediction_source, inference_mode, count(*) as samples, count(*) filter (where ok) as parsed, count(*) filter (where pl = gl) as correct, count(pb) as predicted, count(*) filter (where gl = '{REAL}') as reals, count(*) filter (where gl = '{REAL}' and pl = '{FAKE}') as rfp, {_COUNT('gb', 'pb')} from x group by 1, 2)
select prediction_source, inference_mode, samples, {_r('parsed', 'samples')} as json_parse_rate, {_r('correct', 'samples')} as overall_accuracy, round(case when predicted = samples then ({_f('tp', 'fp', 'fn')} + {_f('tn', 'fn', 'fp')}) / 2 else 0 end, 9) as overall_macro_f1, {_r('rfp', 'reals')} as real_false_positive_rate from c""",
    "explanation_surface": f"with {_EIGHT}, {_PRED}, {_normal('np', 'pd', _PKEY, 'j')}, {_SURF('np', _PKEY)} select {_PKEY}, surface from nps",
    "bleu1_pairs": _PAIRS
    + f""", r as (select {_PKEY}, tok, count(*) as n from ({_SIDE('r')}) group by all), h as (select {_PKEY}, tok, count(*) as n from ({_SIDE('h')}) group by all), o as (select {_PKEY}, sum(least(r.n, h.n)) as s from r join h using ({_PKEY}, tok) group by all)
select {_PKEY}, round(coalesce(s, 0) / len(h)::double * case when len(h) < len(r) then exp(1 - len(r) / len(h)::double) else 1 end, 6) as bleu_1 from pt left join o using ({_PKEY})""",
    "meteor_pairs": _PAIRS
    + f""", r as (select *, row_number() over (partition by {_PKEY}, tok order by pos) as occ from ({_SIDE('r')})), h as (select *, row_number() over (partition by {_PKEY}, tok order by pos) as occ from ({_SIDE('h')})),
m as (select {_PKEY}, h.pos as hp, r.pos as rp from h join r using ({_PKEY}, tok, occ)), c as (select *, case when rp = lag(rp) over (partition by {_PKEY} order by hp) + 1 then 0 else 1 end as brk from m),
a as (select {_PKEY}, count(*) as m, sum(brk) as ch from c group by all)
select {_PKEY}, round(coalesce((1 - 0.5 * pow(ch / m::double, 3)) * 10 * (m / len(h)::double) * (m / len(r)::double) / (m / len(r)::double + 9 * m / len(h)::double), 0), 6) as meteor from pt left join a using ({_PKEY})""",
    "json_parse_events": "select event_id, cast(json_extract(props, '$.k') as integer) as k from events",
    "embedding_linear_score": "select vec_id, round(1 / (1 + exp(-list_sum(list_transform(range(len(embedding)), lambda i: embedding[i + 1]::double * (((i * 37) % 101 - 50) / 100.0::double))))), 6) as score from embeddings",
}
