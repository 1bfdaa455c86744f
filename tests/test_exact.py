"""Queries without SQL against brute force over the whole small tables."""

import json
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from tesselade.dims import CRITERIA, FAKE, REAL
from tesselade.functions import jsonscan
from tesselade.functions.traces import _criterion
from tesselade.plans import catalog, eval_queries

SF = "/root/testdata/sf0.01"


def run(spark, name):
    return [r.asDict() for r in catalog.queries()[name](spark, SF).collect()]


@pytest.fixture(scope="module")
def predictions():
    return pq.read_table(f"{SF}/predictions.parquet", columns=["row_id", "prediction_source", "final_json_text", "final_json_parse_ok"]).to_pylist()


@pytest.fixture(scope="module")
def surfaces(spark):
    return [r.asDict() for r in eval_queries._surfaces(spark, SF).collect()]


def common(a, b):
    """Longest common subsequence by the textbook table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def rouge(pair):
    total = len(pair["r"]) + len(pair["h"])
    return round(2 * common(pair["r"], pair["h"]) / total, 6) if pair["r"] and pair["h"] else 0.0


def test_rouge_l_pairs(spark, surfaces):
    keys = ("row_id", "prediction_source", "inference_mode")
    want = Counter((*(p[k] for k in keys), rouge(p)) for p in surfaces)
    assert Counter((*(r[k] for k in keys), r["rouge_l"]) for r in run(spark, "rouge_l_pairs")) == want and len(want) > 50


def test_explanatory_metrics(spark, surfaces):
    scores = defaultdict(list)
    for p in surfaces:
        scores[p["prediction_source"]].append(rouge(p))
    found = {r["prediction_source"]: r for r in run(spark, "explanatory_metrics")}
    assert {k: r["n"] for k, r in found.items()} == {k: len(v) for k, v in scores.items()}
    for k, v in scores.items():
        assert found[k]["rouge_l"] == pytest.approx(sum(v) / len(v), abs=2e-6)
    for field, name in (("bleu_1", "bleu1_pairs"), ("meteor", "meteor_pairs")):
        pairs = defaultdict(list)
        for r in run(spark, name):
            pairs[r["prediction_source"]].append(r[field])
        for k, v in pairs.items():
            assert found[k][field] == pytest.approx(sum(v) / len(v), abs=2e-6)


def decoded(text):
    at = re.search(r"[{\[]", text or "")
    try:
        return json.JSONDecoder().raw_decode(text, at.start())[0] if at else None
    except ValueError:
        return None


def test_json_parse_predictions(spark, predictions):
    want = Counter((p["prediction_source"], p["final_json_text"] is not None, p["final_json_parse_ok"], decoded(p["final_json_text"]) is not None) for p in predictions)
    found = {(r["prediction_source"], r["given"], r["stored"], r["parses"]): r["n"] for r in run(spark, "json_parse_predictions")}
    assert found == want


def test_json_repair_ladder(spark, predictions):
    """Valid objects keep their label; what is repaired is what was given, bar its end."""
    found = defaultdict(list)
    for r in run(spark, "json_repair_ladder"):
        found[r["row_id"], r["prediction_source"]].append((r["label"], r["parses"]))
    want, broken = defaultdict(list), 0
    for p in predictions:
        if p["final_json_text"] is None:
            continue
        value = decoded(p["final_json_text"])
        if not isinstance(value, dict):
            broken += 1
            value = next((json.loads(c) for c in jsonscan.candidates(p["final_json_text"]) if jsonscan._reads(c)), None)
            words = re.findall(r"\w+", jsonscan.plain_json_text(p["final_json_text"]))
            assert value is None or set(re.findall(r"\w+", json.dumps(value, ensure_ascii=False))) <= set(words)
        label = value.get("overall_likelihood") if isinstance(value, dict) else None
        want[p["row_id"], p["prediction_source"]].append((label, value is not None))
    order = lambda pairs: sorted(pairs, key=str)
    assert {k: order(v) for k, v in found.items()} == {k: order(v) for k, v in want.items()} and broken > 10


def test_trace_payloads(spark, predictions):
    found = Counter((r["row_id"], r["prediction_source"], r["overall_likelihood"], r["positives"]) for r in run(spark, "trace_payloads"))
    want = Counter()
    for p in predictions:
        if p["final_json_text"] is None:
            continue
        text = next((c for c in jsonscan.candidates(p["final_json_text"]) if jsonscan._reads(c)), None)
        value = None if text is None else decoded(text)
        first = {}
        for e in (value or {}).get("per_criterion") or []:
            if isinstance(e, dict):
                first.setdefault(_criterion(e.get("criterion")), e.get("aigc score", e.get("score")))
        scored = [s for c, s in first.items() if c in CRITERIA]
        positives = sum(str(s).strip().lstrip("+-").isdigit() and int(s) != 0 for s in scored)
        label = (value or {}).get("overall_likelihood")
        if not scored:
            want[p["row_id"], p["prediction_source"], None, None] += 1
        else:
            want[p["row_id"], p["prediction_source"], label if label in (REAL, FAKE) else FAKE if positives else REAL, positives] += 1
    assert sum((found - want).values()) == 0


def test_task_targets(spark):
    fields = {"structured": "final_json_target", "final_json": "final_json_target"}
    stored = {}
    for r in pq.read_table(f"{SF}/derived.parquet").to_pylist():
        stored.setdefault(r["row_id"], []).append(r)
    rows = run(spark, "task_targets")
    assert Counter(r["row_id"] for r in rows) == Counter(k for k in stored if k is not None)
    for r in rows:
        if r["task"] in fields and r["target"] is not None:
            assert json.loads(r["target"]).get("overall_likelihood") in {(s[fields[r["task"]]] or {}).get("overall_likelihood") for s in stored[r["row_id"]]}
