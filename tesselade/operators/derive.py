"""Supervision targets from reviewed drafts, one narrow projection a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselade.dims import CRITERIA, DEFAULT_EVIDENCE, FAKE, NEGATIVE_IN_TARGETS, PREDICTION_ALIASES, REAL, TAXONOMY, UNCERTAIN, lookup
from tesselade.functions import text as X

PREDICTED = lookup(PREDICTION_ALIASES)


def target_criterion(name: Column) -> Column:
    """The criterion of a name in predictions; an unknown name comes back cleaned."""
    return X.canonical(name, PREDICTED, X.lookup_key, X.clean_text(name))


def taxonomy(criterion: Column, evidence: Column, score: Column) -> Column:
    """The artifact class of a positive entry; ``none`` for others."""
    low = F.lower(X.clean_text(evidence))
    found = F.when(score == 0, "none")
    for name, rules in TAXONOMY.items():
        for label, markers in rules:
            found = found.when((criterion == name) & X.any_of(low, markers.split("|")), label)
    return found.otherwise("artifact_generic")


def entry_score(entry: Column, names: list[str]) -> Column:
    """0 or 1 from the first of the score fields that the entry has; null is 0."""
    for field in ("final_score", "proposed_score", "score", "aigc score"):
        if field in names:
            return F.when(F.coalesce(entry.getField(field), F.lit(0)) != 0, 1).otherwise(0)
    return F.lit(0)


def _entries(drafts: Column, names: list[str]) -> Column:
    optional = lambda e, f, kind: (e.getField(f) if f in names else F.lit(None)).cast(kind).alias(f)
    return F.transform(
        F.filter(drafts, lambda e: e.isNotNull()),
        lambda e: F.struct(
            target_criterion(e["criterion"]).alias("criterion"), entry_score(e, names).alias("score"), e["evidence"].alias("evidence"), optional(e, "support_type", "string"), optional(e, "holmes_span", "string"),
            F.coalesce(optional(e, "non_applicable", "boolean"), F.lit(False)).alias("non_applicable"), F.coalesce(optional(e, "artifact_score_conflict", "boolean"), F.lit(False)).alias("artifact_score_conflict"),
        ),
    )


def step2_source(df: DataFrame) -> DataFrame:
    """Adds overall and entries: from the internal record, else the draft, else none."""
    internal, draft = (df.schema[c].dataType["per_criterion_draft"].dataType.elementType.names for c in ("step2_internal", "step2_draft"))
    full = F.coalesce(F.size("step2_internal.per_criterion_draft"), F.lit(0)) > 0
    overall = F.when(full, F.col("step2_internal.overall_likelihood")).otherwise(F.col("step2_draft.overall_likelihood"))
    entries = F.when(full, _entries(F.col("step2_internal.per_criterion_draft"), internal)).otherwise(_entries(F.col("step2_draft.per_criterion_draft"), draft))
    return df.withColumn("overall", X.normal_label(overall)).withColumn("entries", entries)


def trace(entries: Column) -> Column:
    """The eight trace entries; the first of a criterion wins, a missing one is neutral."""

    def cell(c: Column, found: Column) -> Column:
        e = F.try_element_at(F.filter(found, lambda x: x["criterion"] == c), F.lit(1))
        said = X.clean_text(e["evidence"])
        score, evidence = F.coalesce(e["score"], F.lit(0)), F.when(said == "", DEFAULT_EVIDENCE).otherwise(said)
        kind = X.clean_text(e["support_type"])
        return F.struct(
            c.alias("criterion"), score.alias("score"), evidence.alias("evidence"), F.when(kind == "", "unsupported").otherwise(kind).alias("support_type"), X.clean_text(e["holmes_span"]).alias("holmes_span"),
            taxonomy(c, evidence, score).alias("artifact_taxonomy"), F.coalesce(e["non_applicable"], F.lit(True)).alias("non_applicable"), F.coalesce(e["artifact_score_conflict"], F.lit(False)).alias("artifact_score_conflict"),
        )

    names = F.array(*map(F.lit, CRITERIA))
    return X.let(F.coalesce(entries, F.array()), lambda found: F.transform(names, lambda c: cell(c, found)))


def any_positive(entries: Column, field: str = "score") -> Column:
    return F.exists(entries, lambda e: e[field] != 0)


def final_json(overall: Column, traced: Column) -> Column:
    """The final target; an uncertain label is inferred from the entries."""
    label = F.when(overall != UNCERTAIN, overall).when(any_positive(traced), FAKE).otherwise(REAL)
    return F.struct(F.transform(traced, lambda e: F.struct(e["criterion"].alias("criterion"), e["evidence"].alias("evidence"), e["score"].alias("aigc score"))).alias("per_criterion"), label.alias("overall_likelihood"))


def compact_trace(traced: Column, evidence_words: int = 14, span_words: int = 12) -> Column:
    def cell(e: Column) -> Column:
        short = F.when(e["evidence"] == DEFAULT_EVIDENCE, DEFAULT_EVIDENCE).otherwise(X.truncate_words(e["evidence"], evidence_words))
        return e.withField("evidence", short).withField("holmes_span", X.truncate_words(e["holmes_span"], span_words))

    return F.transform(traced, cell)


def taxonomy_target(traced: Column) -> Column:
    return F.transform(traced, lambda e: F.struct(e["criterion"].alias("criterion"), e["artifact_taxonomy"].alias("artifact_taxonomy"), e["support_type"].alias("support_type")))


def consistency_target(overall: Column, traced: Column) -> Column:
    """A positive needs evidence without a word of absence, and support."""

    def cell(e: Column) -> Column:
        loose = (e["score"] == 1) & ((e["evidence"] == DEFAULT_EVIDENCE) | X.any_of(F.lower(e["evidence"]), NEGATIVE_IN_TARGETS) | (e["support_type"] == "unsupported"))
        reason = F.when(loose, "positive score lacks grounded artifact evidence").otherwise("evidence supports score")
        return F.struct(e["criterion"].alias("criterion"), (~loose).alias("consistent"), reason.alias("reason"))

    expected = F.when(any_positive(traced), FAKE).otherwise(REAL)
    return F.struct((overall == expected).alias("overall_consistent"), expected.alias("expected_overall_likelihood"), F.transform(traced, cell).alias("per_criterion"))


def quality_flags(overall: Column, traced: Column) -> Column:
    positive = any_positive(traced)
    whole = F.array(F.when((overall == REAL) & positive, "real_has_positive_artifact"), F.when((overall == FAKE) & ~positive, "fake_has_no_positive_artifact"))

    def cell(e: Column) -> Column:
        flag = lambda holds, name: F.when(holds, F.concat(e["criterion"], F.lit(f":{name}")))
        return F.array(flag(e["artifact_score_conflict"], "artifact_score_conflict"), flag((e["score"] != 0) & (e["evidence"] == DEFAULT_EVIDENCE), "positive_without_evidence"))

    return F.array_compact(F.concat(whole, F.flatten(F.transform(traced, cell))))


def derived_rows(teacher: DataFrame, key: Column) -> DataFrame:
    """All targets of teacher rows. ``trace`` is computed once and projected."""
    rows = step2_source(teacher).withColumn("row_id", key).withColumn("traced", trace(F.col("entries")))
    overall, traced = F.col("overall"), F.col("traced")
    return rows.select(
        "row_id", "image", "source", "original_query", "original_response", "step1_target", final_json(overall, traced).alias("final_json_target"), F.struct(overall.alias("overall_likelihood"), traced.alias("per_criterion")).alias("evidence_trace_target"),
        F.struct(overall.alias("overall_likelihood"), taxonomy_target(traced).alias("per_criterion")).alias("taxonomy_target"), consistency_target(overall, traced).alias("consistency_target"), quality_flags(overall, traced).alias("quality_flags"),
    )


def normal_prediction(payload: Column) -> Column:
    """A predicted final JSON with eight entries, first wins, label from the scores.

    The payload's own label is not used. A null payload stays null.
    """

    def cell(c: Column, found: Column) -> Column:
        e = F.try_element_at(F.filter(found, lambda x: x["criterion"] == c), F.lit(1))
        said = X.clean_text(e["evidence"])
        return F.struct(c.alias("criterion"), F.when(said == "", DEFAULT_EVIDENCE).otherwise(said).alias("evidence"), F.when(F.coalesce(e["score"], F.lit(0)) != 0, 1).otherwise(0).alias("aigc score"))

    found = F.transform(F.filter(payload["per_criterion"], lambda e: e.isNotNull()), lambda e: F.struct(target_criterion(e["criterion"]).alias("criterion"), e["evidence"].alias("evidence"), e.getField("aigc score").alias("score")))
    names = F.array(*map(F.lit, CRITERIA))
    eight = X.let(F.coalesce(found, F.array()), lambda f: F.transform(names, lambda c: cell(c, f)))
    whole = X.let(eight, lambda e: F.struct(e.alias("per_criterion"), F.when(any_positive(e, "aigc score"), FAKE).otherwise(REAL).alias("overall_likelihood")))
    return F.when(payload.isNotNull(), whole)


def explanation_surface(normal: Column) -> Column:
    """Eight lines ``criterion | score=s | evidence=e`` and the label's line."""
    line = lambda e: F.concat(e["criterion"], F.lit(" | score="), e.getField("aigc score").cast("string"), F.lit(" | evidence="), e["evidence"])
    return F.array_join(F.concat(F.transform(normal["per_criterion"], line), F.array(F.concat(F.lit("overall_likelihood | "), normal["overall_likelihood"]))), "\n")


def task_target(task: Column, final: Column, traced: Column, classes: Column, consistency: Column) -> Column:
    """The target of a training task as compact JSON, nulls written out."""
    as_json = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    return F.when(task == "final_json", as_json(final)).when(task == "evidence_trace", as_json(traced)).when(task == "taxonomy_classification", as_json(classes)).when(task == "consistency_check", as_json(consistency))
