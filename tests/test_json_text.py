import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesselade.functions import jsonscan as J
from tesselade.functions import text as X


@pytest.mark.parametrize(
    "text,value",
    [
        ('say {"a": 1} and {"b": 2}', '{"a": 1}'), ('{"a": "}"} x', '{"a": "}"}'), ('{"a": "\\"}"} x', '{"a": "\\"}"}'), ('x [1, {"a": [2]}] y', '[1, {"a": [2]}]'),
        ('{"a": [1, 2}', '{"a": [1, 2}'), ("none", "none"), ('{"a": 1', '{"a": 1'), ("", ""),
    ],
)
def test_first_value(text, value):
    assert J.first_value(text) == value


def test_first_object_counts_braces_only():
    assert J.first_object('[1] {"a": [1, 2}] rest') == '{"a": [1, 2}'


@pytest.mark.parametrize("text,value", [('{"a": [1', '{"a": [1]}'), ('{"a": "b', '{"a": "b"}'), ('{"a": 1}', '{"a": 1}'), ('{"a": "b\\"', '{"a": "b\\""}')])
def test_closed(text, value):
    assert J.closed(text) == value


@pytest.mark.parametrize("text", ['```json\n{"a": 1}\n```', '{"a": 1,}', '{"a": 1 "b": 2}', 'so: {"a": 1, "b": [1, 2', "﻿{“a”: 1}", '{"a": 1}\r\ntail'])
def test_repair(text):
    found = next(json.loads(c) for c in J.candidates(text) if J._reads(c))
    assert found["a"] == 1


@pytest.mark.parametrize(
    "text,value",
    [
        ('{"a": 1,}', '{"a": 1}'), ('{"a": 1 "b": [1 2,,3,]}', '{"a": 1, "b": [1, 2,3]}'), ('x {"a": "1, 2}" "b": {"c": [true', '{"a": "1, 2}", "b": {"c": [true]}}'), ('{"a": 1]} tail {', '{"a": 1}'),
        ('[1, 2', "[1, 2]"), ("none", "none"), ("{", "{}"), ('{"a": "b', '{"a": "b"}'), ("", ""), ('{"a": 1,', '{"a": 1,}'),
    ],
)
def test_rebuilt(text, value):
    assert J.rebuilt(text) == value


def test_plain_json_text():
    assert J.plain_json_text("\ufeff```json\r\n{“a”: 1}\r```\n") == '{"a": 1}'
    assert J.plain_json_text("```\n{}") == "{}" and J.plain_json_text(" {}\r\n ") == "{}"


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(max_size=4), v, max_size=4)), st.integers(0, 60))
@settings(max_examples=200, deadline=None)
def test_rebuilt_keeps_what_is_valid(value, cut):
    text = json.dumps([value])
    assert json.loads(J.rebuilt(text)) == [value]
    assert J.rebuilt(text[: max(1, cut)]).count("[") >= 1


def test_udfs(spark):
    df = spark.createDataFrame([('x {"a": 1} y',), ("no",), (None,), ('{"a": 1,}',), ("",)], "t string")
    assert [r[0] for r in df.select(J.json_value("t")).collect()] == ['{"a": 1}', None, None, None, None]
    assert [r[0] for r in df.select(J.repaired_json("t")).collect()] == ['{"a": 1}', None, None, '{"a": 1}', None]


@pytest.mark.parametrize(
    "build,given,want",
    [
        (X.clean_text, "a\xa0b　\tc\x1c", "a b c"), (X.clean_text, None, ""), (X.lookup_key, "Text & Symbols!", "text symbols"), (lambda c: X.truncate_words(c, 2), "a b c", "a b"), (lambda c: X.clip_words_plain(c, 2), "a b, c", "a b"),
        (X.is_viable_fragment, "orange tiles look warped near edge", False), (X.is_viable_fragment, "tiles look warped near the edge", True), (X.sentences, "A b. C d! E? f.g", ["A b.", "C d!", "E?", "f.g"]), (X.sentences, "", []),
        (X.tokens, "It's déjà_vu 3.5%!", ["it", "'", "s", "déjà_vu", "3", ".", "5", "%", "!"]), (X.evidence_sentence, "", "Not assessable due to lack of relevant content"), (X.evidence_sentence, None, "Not assessable due to lack of relevant content"),
        (X.evidence_sentence, "**Light**: It glows... oddly", "It glows."), (lambda c: X.compact_text(c, 4), "one two three four five six seven", "one two three four."), (X.image_member, ".\\dataset\\0_real\\a.png", "0_real/a.png"),
        (X.label_from_member, "1_fake/a.png", "AI-Generated"), (X.label_from_member, "a/0_real/1_fake", "Real"), (X.label_from_member, "x", None), (X.normal_label, " Real", "Real"), (X.normal_label, "real", "Uncertain"),
        (X.description, "Image Description: A hall.\nBased on the provided image", "A hall."),
    ],
)
def test_text(spark, build, given, want):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(given,)], "t string")
    assert df.select(build(F.col("t"))).first()[0] == want


def test_durations(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(3661.4,), (59.0,), (None,), (-1.0,)], "s double")
    assert [r[0] for r in df.select(X.duration(F.col("s"))).collect()] == ["01:01:01", "00:59", "--:--", "--:--"]


def test_score_labels(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.5, 0.5), (0.49, 0.5), (None, 0.5)], "s double, t double")
    assert [r[0] for r in df.select(X.label_from_score(F.col("s"), F.col("t"))).collect()] == ["AI-Generated", "Real", None]
