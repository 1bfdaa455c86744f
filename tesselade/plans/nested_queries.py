"""Queries of the nested-record operator."""

from __future__ import annotations

from tesselade.operators.nested import links, shred
from tesselade.session import table

BRANCHES = {
    "final_json": "final_json_target.per_criterion",
    "evidence_trace": "evidence_trace_target.per_criterion",
    "consistency": "consistency_target.per_criterion",
    "quality_flags": "quality_flags",
}
KEPT = ("row_id", *dict.fromkeys(b.split(".")[0] for b in BRANCHES.values()), "ingested_at")


def p3_found(spark, sf_dir):
    return links(table(spark, sf_dir, "derived"), "row_id", BRANCHES, "ingested_at")


def _tables(spark, sf_dir):
    derived = table(spark, sf_dir, "derived").select(*KEPT)
    return shred(derived, "row_id", "ingested_at", skip=("ingested_at",))


def _query(name):
    return lambda spark, sf_dir: _tables(spark, sf_dir)[name]


QUERIES = {
    "p3_found": p3_found,
    "p3_records": _query("record"),
    "p3_final_json": _query("final_json_target_per_criterion"),
    "p3_evidence_trace": _query("evidence_trace_target_per_criterion"),
    "p3_consistency": _query("consistency_target_per_criterion"),
    "p3_quality_flags": _query("quality_flags"),
}

_ONE = "(select * from derived where row_id is not null qualify row_number() over (partition by row_id order by ingested_at nulls last) = 1)"


def _child(path, columns):
    cells = ", ".join(f"{c} as {a}" for c, a in columns)
    return f"""select row_id, concat('{path}[', pos, ']') as node, '' as parent, 'record' as parent_table, '{path}' as branch, cast(pos as integer) as pos, {cells}
from (select row_id, unnest({path}) as e, unnest(range(len({path}))) as pos from {_ONE} t) where e is not null"""


ORACLE = {
    "p3_found": " union all ".join(
        f"select distinct row_id, '{label}' as branch, cast(pos as integer) as pos from (select row_id, unnest({path}) as e, unnest(range(len({path}))) as pos from derived) where e is not null and row_id is not null"
        for label, path in BRANCHES.items()
    ),
    "p3_records": f"""select row_id, final_json_target.overall_likelihood as final_json_target_overall_likelihood,
 evidence_trace_target.overall_likelihood as evidence_trace_target_overall_likelihood,
 consistency_target.overall_consistent as consistency_target_overall_consistent,
 consistency_target.expected_overall_likelihood as consistency_target_expected_overall_likelihood from {_ONE} t""",
    "p3_final_json": _child(BRANCHES["final_json"], [("e.criterion", "criterion"), ("e.evidence", "evidence"), ('e."aigc score"', "aigc_score")]),
    "p3_evidence_trace": _child(
        BRANCHES["evidence_trace"],
        [(f"e.{c}", c) for c in ("criterion", "score", "evidence", "support_type", "holmes_span", "artifact_taxonomy", "non_applicable", "artifact_score_conflict")],
    ),
    "p3_consistency": _child(BRANCHES["consistency"], [(f"e.{c}", c) for c in ("criterion", "consistent", "reason")]),
    "p3_quality_flags": _child("quality_flags", [("e", "value")]),
}
