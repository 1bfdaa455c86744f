"""Prompts as text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def final_prompt(template: str, trace: Column) -> Column:
    """The template, then the compact trace as JSON."""
    return F.concat(F.lit(template.strip() + "\n\n"), F.to_json(trace, {"ignoreNullFields": "false"}))


def anchor_prompt(instructions: str, label: Column, query: Column, response: Column, anchors: Column) -> Column:
    """What a drafting model reads: fixed label, question, explanation, anchors."""
    lines = F.transform(anchors, lambda a: F.concat_ws(" | ", a["criterion"], a["support_type"], a["holmes_span"]))
    return F.concat_ws("\n", F.lit(instructions.strip()), F.concat(F.lit("Label: "), label), F.concat(F.lit("Query: "), query), F.concat(F.lit("Explanation: "), response), F.lit("Anchors:"), F.array_join(lines, "\n"))


def review_prompt(instructions: str, label: Column, drafts: Column) -> Column:
    """What a reviewing model reads: the label and the drafts in brief."""
    slim = F.transform(drafts, lambda d: F.struct(d["criterion"].alias("criterion"), d["proposed_score"].alias("proposed_score"), d["evidence"].alias("evidence"), d["support_type"].alias("support_type")))
    return F.concat_ws("\n", F.lit(instructions.strip()), F.concat(F.lit("Label: "), label), F.to_json(slim))


def specialist_prompt(instructions: str, criterion: Column, draft: Column) -> Column:
    """What a specialist of one criterion reads."""
    return F.concat_ws("\n", F.lit(instructions.strip()), F.concat(F.lit("Criterion: "), criterion), F.to_json(draft))
