import json

import pytest
from pyspark.sql import functions as F

from tesselade.config import Settings, retry_budget, task_mix
from tesselade.dims import CRITERIA, DEFAULT_EVIDENCE, FAKE, REAL, UNCERTAIN
from tesselade.functions.clip_tokens import clip_tokens
from tesselade.functions.traces import normal_trace, normal_trace_json
from tesselade.operators import derive
from tesselade.operators.metrics import probe_accuracies

TEXT = "Text & Symbols"
ENTRY = {"criterion": "text and symbols", "score": "1", "evidence": " garbled  words ", "support_type": "explicit_holmes"}


@pytest.mark.parametrize(
    "payload",
    [[ENTRY], [None, 3, ENTRY, {**ENTRY, "score": 0}], {"per_criterion": [ENTRY], "overall_likelihood": "?"}, ENTRY, {TEXT: 1, "evidence": "garbled words", "support_type": "explicit_holmes", "artifact_taxonomy": "text_gibberish"}],
)
def test_shapes(payload):
    trace = normal_trace(payload)
    entry = next(e for e in trace["per_criterion"] if e["criterion"] == TEXT)
    assert trace["overall_likelihood"] == FAKE and [e["criterion"] for e in trace["per_criterion"]] == list(CRITERIA)
    assert (entry["score"], entry["evidence"], entry["support_type"], entry["artifact_taxonomy"]) == (1, "garbled words", "explicit_holmes", "text_gibberish")
    assert sum(e["non_applicable"] for e in trace["per_criterion"]) == 7


def test_odd_shapes():
    assert normal_trace(None) is normal_trace("x") is normal_trace({}) is normal_trace([1]) is None
    drafts = normal_trace({"per_criterion_draft": [{"criterion": TEXT, "final_score": None, "proposed_score": 1}], "overall_likelihood": "x"})
    assert drafts["overall_likelihood"] == UNCERTAIN and all(e["score"] == 0 for e in drafts["per_criterion"])  # a present null wins
    assert normal_trace([{**ENTRY, "score": "high"}])["overall_likelihood"] == REAL


def test_trace_udf(spark):
    df = spark.createDataFrame([('so: {"criterion": "text symbols", "score": 1}',), ("{",), (None,)], "t string")
    found = [r[0] for r in df.select(normal_trace_json("t")).collect()]
    assert json.loads(found[0])["overall_likelihood"] == FAKE and found[1:] == [None, None]


def test_normal_prediction_agrees_with_traces(spark):
    kind = "struct<per_criterion:array<struct<criterion:string,evidence:string,`aigc score`:int>>,overall_likelihood:string>"
    payload = ([("text symbols", " a  b ", 1), (TEXT, "later", 0), None, ("Edges & Boundaries", None, None), ("who", "x", 1)], "Real")
    r = spark.createDataFrame([(payload,), (None,), (([], None),)], f"p {kind}").select(derive.normal_prediction(F.col("p")).alias("n")).collect()
    assert r[1].n is None and r[2].n.overall_likelihood == REAL
    assert r[0].n.overall_likelihood == FAKE and [e.evidence for e in r[0].n.per_criterion][5] == "a b" and r[0].n.per_criterion[1].evidence == DEFAULT_EVIDENCE


def test_clip_tokens(spark):
    df = spark.createDataFrame([("A  Photo &amp;amp; more",), ("a photo & more",), (None,), ("word " * 500,)], "t string")
    ids = [r[0] for r in df.select(clip_tokens(F.col("t"))).collect()]
    assert ids[0] == ids[1] and all(len(x) == 77 and x[0] == 49406 for x in ids)
    assert ids[2][:3] == [49406, 49407, 0] and ids[3][-1] == 49407


def test_settings(tmp_path):
    s = Settings({"a": {"b": 1}})
    s.override({"a.b": None, "a.c": 2, "d.e": "", "d.f": 0})
    assert s.get("a.b") == 1 and s.get("a.c") == 2 and s.get("d.e", 9) == 9 and s.get("d.f") == 0 and s.get("a.b.c") is None
    s.save(str(tmp_path / "s.json"))
    assert Settings.load(str(tmp_path / "s.json")).values == s.values
    assert task_mix('{"a": 1}') == task_mix("a=1,") == {"a": 1.0} and sum(task_mix("").values()) == pytest.approx(1)
    assert [retry_budget(n) for n in (100, 1500, 4000)] == [1124, 3000, 3072]


def test_probes(spark):
    df = spark.createDataFrame([("Real", "Real", None), ("Real", "x", "Real")], "gold string, a string, b string")
    r = probe_accuracies(df, "gold", {"blank": "a", "oracle": "b"}).first()
    assert (r.samples, r.blank_parse_rate, r.blank_accuracy, r.oracle_parse_rate, r.oracle_accuracy) == (2, 1.0, 0.5, 0.5, 0.5)
