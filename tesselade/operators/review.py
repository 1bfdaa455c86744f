"""From a free-text explanation to reviewed scores of the eight criteria.

The eight entries of a record are eight rows in canonical order (``idx``). All
steps are projections but two running windows over the rows of a record, which
share one sort; a source that is already partitioned by its key, as after
removing repeated deliveries, needs no further shuffle for them. Counters are
names in an array column of each row and are summed by an aggregation, which,
unlike accumulators, counts right under task retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselade.dims import ANCHOR_ALIASES, ARTIFACT, CONSISTENCIES, CRITERIA, DEFAULT_EVIDENCE, FAKE, HIGH_RISK, MATERIAL, MATERIAL_EXCLUDED, MATERIAL_POSITIVE, NEGATIVE_IN_DRAFTS, REAL, RECOMMENDATIONS, SUPPORT_TYPES, VERDICTS, lookup
from tesselade.functions import text as X

KEYS = {c.lower(): c for c in CRITERIA} | lookup(ANCHOR_ALIASES)
DRAFT_FIELDS = ("proposed_score", "evidence", "support_type", "holmes_span", "artifact_score_conflict", "non_applicable")
REVIEW_FIELDS = ("verdict", "reason", "score_consistency", "recommended_score")


def known_criterion(name: Column) -> Column:
    return X.canonical(name, KEYS, lambda c: F.lower(X.clean_text(c)))


def supported(kind: Column) -> Column:
    return kind.isin("explicit_holmes", "implied_holmes")


def says_no(value: Column) -> Column:
    return X.any_of(F.lower(value), NEGATIVE_IN_DRAFTS)


def artifact_evidence(value: Column) -> Column:
    """Names an artifact or, without a word of absence, says six words."""
    t = F.lower(X.clean_text(value))
    plain = (t != "") & ~t.isin(DEFAULT_EVIDENCE.lower(), "none.") & ~X.any_of(t, NEGATIVE_IN_DRAFTS)
    return plain & (X.any_of(t, ARTIFACT) | (X.word_count(value) >= 6))


def material_evidence(value: Column) -> Column:
    t = F.lower(X.clean_text(value))
    return (t != "") & (t != DEFAULT_EVIDENCE.lower()) & ~X.any_of(t, MATERIAL_EXCLUDED) & X.any_of(t, MATERIAL_POSITIVE)


def implied_positive(label: Column, kind: Column, evidence: Column, span: Column) -> Column:
    t = F.lower(X.clean_text(F.concat_ws(" ", evidence, span)))
    return (label == FAKE) & (t != "") & ~X.any_of(t, NEGATIVE_IN_DRAFTS) & (supported(kind) | ((kind == "image_only") & X.any_of(t, ARTIFACT)))


def image_only_policy(criterion: Column) -> Column:
    """struct<policy, min_words>: how much an image-only finding must say."""
    policy = F.when(criterion == MATERIAL, "broad").when(criterion.isin(CRITERIA[4], CRITERIA[6]), "moderate").when(criterion == CRITERIA[5], "limited").otherwise("strict")
    least = F.when(policy == "broad", 4).when(policy == "moderate", 5).when(policy == "limited", 7).otherwise(9)
    return F.struct(policy.alias("policy"), least.alias("min_words"))


def source_rows(df: DataFrame) -> DataFrame:
    """Source records with member path, label, trimmed query and response.

    The first image counts. A record without an image, or whose path names no
    label, gets a null label.
    """
    ends = r"^[\t-\r\x1c-\x20\x85\p{Z}]+|[\t-\r\x1c-\x20\x85\p{Z}]+$"
    member = X.image_member(F.try_element_at("images", F.lit(1)))
    rows = df.select("line_no", member.alias("member"), F.regexp_replace(X.text(F.col("query")), ends, "").alias("query"), F.regexp_replace(X.text(F.col("response")), ends, "").alias("response"))
    return rows.withColumn("label", X.label_from_member(F.col("member")))


def anchored(df: DataFrame) -> DataFrame:
    """Eight rows a record of ``response``: idx, criterion, support_type, holmes_span.

    A section of its own is explicit support; else the first alias that the
    text holds is implied support with the sentence around it; else none.
    """
    response = F.col("response")
    named = F.transform(X.sections(response), lambda s: F.struct(known_criterion(s["name"]).alias("criterion"), s["body"].alias("body")))
    low = F.lower(X.text(response))
    held = F.array_compact(F.array(*[F.when(X.holds_alias(low, a), F.struct(F.lit(c).alias("criterion"), F.lit(a).alias("alias"), F.lit(X.alias_pattern(a)).alias("pattern"))) for a, c in lookup(ANCHOR_ALIASES).items()]))
    rows = df.withColumn("_sections", named).withColumn("_held", held).withColumn("_said", X.sentences(response))
    others = [c for c in rows.columns if c not in ("_sections", "_held", "_said", "response")]
    rows = rows.select(*others, "_sections", "_held", "_said", F.posexplode(F.array(*map(F.lit, CRITERIA))).alias("idx", "criterion"))
    own = lambda x: x["criterion"] == F.col("criterion")
    rows = rows.select(*others, "idx", "criterion", "_said", F.try_element_at(F.filter("_sections", own), F.lit(1))["body"].alias("_body"), F.try_element_at(F.filter("_held", own), F.lit(1)).alias("_alias"))
    around = F.try_element_at(F.filter("_said", lambda s: F.regexp_like(F.lower(s), F.col("_alias.pattern"))), F.lit(1))
    implied = F.when(F.col("_body").isNull() & F.col("_alias").isNotNull(), F.coalesce(around, F.col("_alias.alias")))
    rows = rows.select(*others, "idx", "criterion", "_body", implied.alias("_implied"))
    kind = F.when(F.col("_body").isNotNull(), "explicit_holmes").when(F.col("_implied").isNotNull(), "implied_holmes").otherwise("unsupported")
    rows = X.with_evidence(rows.withColumn("support_type", kind), "holmes_span", F.coalesce("_body", "_implied"))
    return rows.withColumn("holmes_span", F.coalesce("holmes_span", F.lit(""))).drop("_body", "_implied")


def heuristic_drafts(anchors: DataFrame) -> DataFrame:
    """Adds proposed_score and evidence straight from the anchors."""
    span = F.col("holmes_span")
    rows = X.with_evidence(anchors, "evidence", F.when(span != "", span))
    score = F.when((span != "") & (F.col("label") == FAKE) & supported(F.col("support_type")), 1).otherwise(0)
    return rows.withColumns({"evidence": F.coalesce("evidence", F.lit(DEFAULT_EVIDENCE)), "proposed_score": score})


def given_drafts(df: DataFrame, drafts: str) -> DataFrame:
    """Eight rows a record from an array of drafts, the last of a criterion first served.

    ``given`` tells whether the record had an entry for the criterion; its
    fields are null where it hadn't.
    """
    names = F.transform(F.coalesce(F.col(drafts), F.array().cast(dict(df.dtypes)[drafts])), lambda d: known_criterion(d["criterion"]))
    rows = df.withColumn("_names", names)
    others = [c for c in rows.columns if c not in ("_names", drafts)]
    rows = rows.select(*others, "_names", drafts, F.posexplode(F.array(*map(F.lit, CRITERIA))).alias("idx", "criterion"))
    at = F.size("_names") - F.array_position(F.reverse("_names"), F.col("criterion")).cast("int") + 1
    mine = F.when(F.array_contains("_names", F.col("criterion")), F.element_at(drafts, at))
    rows = rows.select(*others, "idx", "criterion", mine.alias("_mine"))
    have = set(df.schema[drafts].dataType.elementType.names)
    return rows.select(*others, "idx", "criterion", F.col("_mine").isNotNull().alias("given"), *[(F.col(f"_mine.{f}") if f in have else F.lit(None)).alias(f) for f in DRAFT_FIELDS])


def judge_input(drafts: DataFrame) -> DataFrame:
    """Given drafts made valid for a review: the review-only path."""
    kind = F.lower(X.clean_text(F.col("support_type")))
    evidence = X.clean_text(F.col("evidence"))
    return drafts.withColumns(
        {
            "support_type": F.when(F.col("given") & kind.isin(*SUPPORT_TYPES), kind).otherwise("unsupported"),
            "proposed_score": F.when(F.coalesce("proposed_score", F.lit(0)) != 0, 1).otherwise(0),
            "evidence": F.when(evidence == "", DEFAULT_EVIDENCE).otherwise(evidence),
            "holmes_span": X.clean_text(F.col("holmes_span")),
            "artifact_score_conflict": F.coalesce("artifact_score_conflict", F.lit(False)),
            "non_applicable": F.coalesce("non_applicable", ~F.col("given")),
        }
    )


def normal_drafts(drafts: DataFrame) -> DataFrame:
    """Valid drafts, whatever a model gave, and ``counters`` of the repairs.

    Needs the draft fields, ``given``, ``label`` and the anchor's kind and
    span as ``anchor_kind`` and ``anchor_span``; a missing entry is filled
    from its anchor.
    """
    label, kind, criterion, given = F.col("label"), F.col("support_type"), F.col("criterion"), F.col("given")
    default = F.lit(DEFAULT_EVIDENCE)
    stated = F.lower(X.clean_text(kind))
    rows = drafts.withColumns({"_valid": F.coalesce(stated.isin(*SUPPORT_TYPES), F.lit(False)), "_on": F.when(F.coalesce("proposed_score", F.lit(0)) != 0, 1).otherwise(0)})
    inferred = F.when((F.col("_on") == 1) & (F.col("anchor_span") == "") & (label == FAKE), "image_only").otherwise(F.col("anchor_kind"))
    rows = rows.withColumn("support_type", F.when(~given, F.col("anchor_kind")).when(F.col("_valid"), stated).otherwise(inferred))
    rows = X.with_evidence(rows, "_span", F.when(given, X.text(F.col("holmes_span"))), 32)
    rows = X.with_evidence(rows, "_said", F.when(given, X.text(F.col("evidence"))).when(F.col("anchor_span") != "", F.col("anchor_span")))
    rows = rows.withColumns({"_span": F.coalesce("_span", "anchor_span"), "_said": F.coalesce("_said", default)})
    rows = rows.withColumn("_weak", (kind == "implied_holmes") & (X.word_count(F.col("_said")) < 4))
    rows = X.with_evidence(rows, "_again", F.when(F.col("_weak") & given, F.col("_span")))
    rows = rows.withColumn("evidence", F.when(F.col("_weak"), F.coalesce("_again", default)).otherwise(F.col("_said")))
    rows = rows.withColumn("_off", given & (kind == "image_only") & (criterion == MATERIAL) & ~material_evidence(F.col("evidence")))
    rows = rows.withColumn("_blocked", ~F.col("_off") & (label == REAL) & (kind == "image_only"))
    rows = rows.withColumn("support_type", F.when(F.col("_off") | F.col("_blocked"), "unsupported").otherwise(kind))
    none = kind == "unsupported"
    positive = implied_positive(label, kind, F.col("evidence"), F.col("_span")) | ((kind == "image_only") & artifact_evidence(F.col("evidence")))
    rows = rows.withColumns({"_no": says_no(F.col("evidence")), "_positive": positive, "_bare": F.col("evidence") == default})
    idle = F.col("_no") | none | (~given & F.col("_bare"))
    rows = rows.withColumns({"proposed_score": F.when(none | F.col("_no") | ~given, 0).otherwise(F.col("_on")), "non_applicable": idle})
    clash = ((label == FAKE) & F.col("_positive") & ~none & (F.col("proposed_score") == 0)) | ((F.col("proposed_score") == 1) & F.col("non_applicable"))
    notes = F.array_compact(
        F.array(
            F.when(given & ~F.col("_valid"), "json_repair_count"),
            F.when(F.col("_off"), "stage1_material_boundary_downgrade_count"),
            F.when(~given, "criterion_fill_in_count"),
            F.when(F.col("_blocked"), "real_image_only_block_count"),
        )
    )
    rows = rows.withColumns({"evidence": F.when(none, default).otherwise(F.col("evidence")), "holmes_span": F.when(none, "").otherwise(F.col("_span")), "artifact_score_conflict": F.coalesce(clash, F.lit(False)), "counters": notes})
    return rows.drop("_valid", "_on", "_span", "_said", "_weak", "_again", "_off", "_blocked", "_no", "_positive", "_bare", "given", "anchor_kind", "anchor_span")


def _key(span: str, evidence: str) -> Column:
    s = X.clean_text(F.col(span))
    return F.lower(F.when(s != "", s).otherwise(X.clean_text(F.col(evidence))))


def _before(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)


def judge(drafts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds verdict, reason, score_consistency and recommended_score."""
    label, kind = F.col("label"), F.col("support_type")
    rows = drafts.withColumns({"_span": X.clean_text(F.col("holmes_span")), "_said": X.clean_text(F.col("evidence")), "_on": F.col("proposed_score") != 0})
    on, span, said = F.col("_on"), F.col("_span"), F.col("_said")
    rows = rows.withColumn("_key", F.lower(F.when(span != "", span).otherwise(said)))
    # Each rule: condition, verdict, reason; the first that holds decides. The reasons are fixed values.
    risky, specific = F.col("criterion").isin(*HIGH_RISK), X.word_count(said) >= 4
    image = kind == "image_only"
    ladder = [
        (~on, "accept", "Negative or neutral entry kept as non-positive evidence."),
        (label == REAL, "downgrade_to_0", "Real samples do not allow positive AIGC criteria."),
        (kind == "explicit_holmes", "accept", "Directly supported by Holmes wording."),
        ((kind == "implied_holmes") & (span != ""), "accept", "Holmes wording strongly implies this criterion."),
        (kind == "implied_holmes", "downgrade_to_0", "Implied support is too weak."),
        (image & risky, "needs_specialist_check", "Image-only positive on a high-risk criterion requires specialist review."),
        (image & specific, "accept", "Image-only issue is specific enough for a low-risk criterion."),
        (image, "downgrade_to_0", "Image-only evidence is too generic."),
        (X.any_of(F.lower(said), ARTIFACT), "accept", "Evidence includes concrete artifact language."),
    ]
    verdict, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for holds, v, r in reversed(ladder):
        verdict, reason = F.when(holds, v).otherwise(verdict), F.when(holds, r).otherwise(reason)
    rows = rows.withColumns({"verdict": F.coalesce(verdict, F.lit("downgrade_to_0")), "reason": F.coalesce(reason, F.lit("Proposed criterion is not sufficiently supported."))})
    clash, idle, real, accepted = F.col("artifact_score_conflict"), F.col("non_applicable") & on, on & (label == REAL), F.col("verdict") == "accept"
    advice = (
        F.when(clash, F.when((label == FAKE) & supported(kind) & accepted, "set_to_1").otherwise("set_to_0"))
        .when(idle | real, "set_to_0").when(F.col("verdict") == "needs_specialist_check", "defer_to_specialist").otherwise("keep")
    )
    rows = rows.withColumns({"score_consistency": F.when(clash | idle | real, "inconsistent").otherwise("consistent"), "recommended_score": advice, "_counts": on & accepted & (F.col("_key") != "")})
    rows = rows.withColumn("_seen", F.collect_list(F.when(F.col("_counts"), F.col("_key"))).over(_before(keys)))
    again = F.col("_counts") & F.array_contains("_seen", F.col("_key"))
    new = {"verdict": "downgrade_to_0", "reason": "Redundant with another accepted positive criterion.", "score_consistency": "inconsistent", "recommended_score": "set_to_0"}
    return rows.withColumns({c: F.when(again, v).otherwise(F.col(c)) for c, v in new.items()}).drop("_span", "_said", "_on", "_key", "_counts", "_seen")


def normal_reviews(drafts: DataFrame, reviews: str) -> DataFrame:
    """Adds valid review columns from an array of model reviews.

    The last review of a criterion wins, words outside the enumerations fall
    back, and a missing review accepts a zero and downgrades a positive.
    """
    mine = F.try_element_at(F.filter(reviews, lambda r: known_criterion(r["criterion"]) == F.col("criterion")), F.lit(-1))
    rows = drafts.withColumn("_r", mine)
    low = lambda f: F.lower(X.clean_text(F.col(f"_r.{f}")))
    zero, given = F.coalesce("proposed_score", F.lit(0)) == 0, F.col("_r").isNotNull()
    good = {"verdict": low("verdict").isin(*VERDICTS), "score_consistency": low("score_consistency").isin(*CONSISTENCIES), "recommended_score": low("recommended_score").isin(*RECOMMENDATIONS)}
    stated = F.when(X.text(F.col("_r.reason")) == "", "No judge reason provided.").otherwise(F.col("_r.reason"))
    rows = X.with_compact(rows, "reason", stated, 25, X.clean_text(stated))
    notes = F.array_compact(F.array(*[F.when(given & ~g, "json_repair_count") for g in good.values()], F.when(~given & ~zero, "judge_missing_review_count")))
    return rows.withColumns(
        {
            "reason": F.when(given, F.col("reason")).otherwise("Fallback review applied during normalization."),
            "verdict": F.when(given, F.when(good["verdict"], low("verdict")).otherwise("downgrade_to_0")).otherwise(F.when(zero, "accept").otherwise("downgrade_to_0")),
            "score_consistency": F.when(given & good["score_consistency"], low("score_consistency")).otherwise("consistent"),
            "recommended_score": F.when(given, F.when(good["recommended_score"], low("recommended_score")).otherwise("keep")).otherwise(F.when(zero, "keep").otherwise("set_to_0")),
            "review_counters": notes,
        }
    ).drop("_r", reviews)


def finalize(reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the final score, what became of evidence and verdict, and counters.

    Entries that need a specialist get the heuristic one, which accepts where
    there is a span. Positives that repeat a key, or are a second image-only
    one, fall to 0; a fake record without positive gets its first supported
    entry back; last come the four ordered export rules.
    """
    label, kind = F.col("label"), F.col("support_type")
    before = _before(keys)
    whole = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    special, fake = F.col("verdict") == "needs_specialist_check", label == FAKE
    rows = reviews.withColumns({"_trusted": X.clean_text(F.col("holmes_span")) != "", "_on": F.col("proposed_score") != 0})
    rows = X.with_compact(rows, "holmes_span", F.col("holmes_span"), 30, X.clean_text(F.col("holmes_span")))
    said = F.when(X.text(F.col("evidence")) == "", DEFAULT_EVIDENCE).otherwise(F.col("evidence"))
    rows = X.with_compact(rows.withColumn("evidence", said), "evidence", F.col("evidence"), 25, X.clean_text(F.col("evidence")))
    note = F.when(F.col("_trusted"), "Specialist accepted because Holmes provides criterion-specific support.").otherwise("Specialist downgraded because support is image-only or too weak.")
    rows = rows.withColumn("_positive", implied_positive(label, kind, F.col("evidence"), F.col("holmes_span")))
    may = F.col("_on") | F.col("_positive")
    f0 = fake & F.when(special, F.col("_trusted") & may).when(F.col("recommended_score") == "set_to_0", False).otherwise((F.col("verdict") == "accept") & may)
    rows = rows.withColumns(
        {
            "specialist_used": special,
            "specialist_verdict": F.when(special, F.when(F.col("_trusted"), "accept").otherwise("downgrade_to_0")),
            "specialist_confidence": F.when(special, F.when(F.col("_trusted"), "high").otherwise("medium")),
            "judge_reason": F.when(special, note).otherwise(F.col("reason")),
            "_f": F.coalesce(f0, F.lit(False)),
            "_key": _key("holmes_span", "evidence"),
        }
    )
    only = F.col("_f") & (kind == "image_only")
    rows = rows.withColumn("_earlier", F.coalesce(F.max(only).over(before), F.lit(False)))
    rows = rows.withColumns({"_capped": only & F.col("_earlier"), "_f": F.col("_f") & ~(only & F.col("_earlier")) & (kind != "unsupported") & ~says_no(F.col("evidence"))})
    rows = rows.withColumn("_seen", F.collect_list(F.when(F.col("_f") & (F.col("_key") != ""), F.col("_key"))).over(before))
    rows = rows.withColumn("_again", F.col("_f") & F.array_contains("_seen", F.col("_key")))
    rows = rows.withColumn("_f", F.col("_f") & ~F.col("_again"))
    spanless = F.col("holmes_span") == ""
    bare = spanless & F.when(fake, ~F.col("_f") & kind.isin("unsupported", "image_only")).otherwise(~supported(kind))
    rows = X.with_evidence(rows, "evidence", F.when(bare, DEFAULT_EVIDENCE).otherwise(F.col("evidence")))
    able = supported(kind) & ~spanless
    rows = rows.withColumns({"_any": F.max("_f").over(whole), "_able": able, "_first": ~F.coalesce(F.max(able).over(before), F.lit(False))})
    rows = rows.withColumn("_back", fake & ~F.col("_any") & F.col("_able") & F.col("_first"))
    reason = F.when(F.col("_back"), "Fallback positive restored from Holmes-supported evidence.").when(F.col("_again"), "Redundant with another accepted positive criterion.")
    reason = reason.when(F.col("_capped"), "Image-only positives are capped at one per fake sample.").otherwise(F.col("judge_reason"))
    rows = rows.withColumns({"judge_verdict": F.when(F.col("_back"), "accept").otherwise(F.col("verdict")), "judge_reason": reason, "_s": F.col("_f") | F.col("_back")})
    rows = X.with_evidence(rows, "exported_evidence", F.col("evidence"))
    rows = rows.withColumn("_x1", F.col("_s") & (F.col("exported_evidence") == DEFAULT_EVIDENCE))
    rows = rows.withColumn("_x2", F.col("_s") & ~F.col("_x1") & (F.col("judge_verdict") == "downgrade_to_0"))
    raised = fake & F.col("judge_verdict").isin("accept", "needs_specialist_check") & supported(kind) & artifact_evidence(F.col("evidence"))
    rows = rows.withColumn("_s", F.col("_s") & ~F.col("_x1") & ~F.col("_x2"))
    rows = rows.withColumn("_x3", raised & ~F.col("_s"))
    rows = rows.withColumn("_x4", (label == REAL) & (F.col("_s") | F.col("_x3")))
    fix = F.lit("export_consistency_fix_count")
    counters = F.array_compact(
        F.array(
            F.when(~fake & (~spanless | supported(kind)), "real_supported_zero_count"),
            F.when(F.col("_capped"), "image_only_cap_downgrade_count"),
            F.when(F.col("_again"), "redundant_positive_downgrade_count"),
            F.when((F.col("verdict") == "downgrade_to_0") & F.col("_on"), "judge_downgrade_count"),
            F.when(special, "specialist_check_count"),
            F.when((kind == "image_only") & F.col("_on"), "image_only_positive_count"),
            F.when(F.col("_back"), "fake_positive_fallback_count"),
            *[F.when(F.col(f"_x{i}"), fix) for i in (1, 2, 3, 4)],
            F.when(F.col("idx") == 0, "official_export_rows"),
        )
    )
    rows = rows.withColumns({"final_score": ((F.col("_s") | F.col("_x3")) & ~F.col("_x4")).cast("int"), "final_counters": counters})
    return rows.drop(*[c for c in rows.columns if c.startswith("_")], "verdict", "reason")


def reviewed(df: DataFrame, keys: list[str]) -> DataFrame:
    """The full chain on ``response`` and ``label``; unlabelled rows are left out."""
    rows = heuristic_drafts(anchored(df.where(F.col("label").isNotNull())))
    rows = rows.withColumns({"anchor_kind": F.col("support_type"), "anchor_span": F.col("holmes_span"), "given": F.lit(True)})
    return finalize(judge(normal_drafts(rows), keys), keys)


def step1_points(drafts: DataFrame, described: DataFrame, key: str) -> DataFrame:
    """(key, step1_target): the description, then evidences with a span, three at most."""
    # Absent points are dropped after collecting: a filter here would be pushed into the evidence chain and repeat it.
    points = drafts.select(key, "idx", F.when(F.col("holmes_span") != "", X.step1_segment(F.col("evidence"))).alias("point"))
    opening = described.select(key, F.lit(-1).alias("idx"), F.when(F.col("description") != "", X.step1_segment(F.col("description"))).alias("point"))
    listed = points.union(opening).groupBy(key).agg(F.filter(F.array_sort(F.collect_list(F.struct("idx", "point"))), lambda p: p["point"].isNotNull()).alias("points"))
    rows = listed.withColumn("points", F.slice("points", 1, 3))
    none = F.lit("Holmes explanation mapped into canonical criteria with fixed label supervision.")
    said = F.array_join(F.filter(F.transform("points", lambda p: p["point"]), lambda p: p != ""), "; ")
    return rows.select(key, F.concat(F.lit("Key points: "), F.when(F.size("points") == 0, none).otherwise(said)).alias("step1_target"))
