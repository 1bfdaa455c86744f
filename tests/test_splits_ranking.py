import random

import pytest
from pyspark.sql import functions as F

from tesselade.operators.checkpoints import latest_checkpoint, ranked_reports
from tesselade.operators.ranking import running, shuffled
from tesselade.operators.splits import balanced_slice, eval_quota, interleave, stratified_sample, stratified_split, task_pick


def rows(spark, n=500):
    return spark.range(n).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "Real").when(F.col("id") % 50 == 1, None).otherwise("AI-Generated").alias("label"))


@pytest.mark.parametrize("n,quota", [(1, 1), (2, 1), (5, 1), (25, 2), (16035, 1604)])
def test_quota(spark, n, quota):
    assert spark.range(1).select(eval_quota(F.lit(n).cast("bigint"), 0.1)).first()[0] == quota


def test_split(spark):
    df = rows(spark)
    found = stratified_split(df, "row_id", "label", 0.1).collect()
    assert len(found) == 500 and len({r.row_id for r in found}) == 500
    held = [r for r in found if r.split == "eval"]
    assert {label: sum(r.label == label for r in held) for label in ("Real", "AI-Generated", None)} == {"Real": 17, "AI-Generated": 33, None: 1}
    again = stratified_split(df.repartition(7), "row_id", "label", 0.1)
    assert {r.row_id for r in again.where("split = 'eval'").collect()} == {r.row_id for r in held}


def test_running(spark):
    rng = random.Random(1)
    data = [(rng.choice(["a", "b", None]), rng.randint(0, 9), i, rng.randint(0, 5)) for i in range(400)]
    df = spark.createDataFrame(data, "g string, s int, k int, v int")
    found = {r.k: (r["rank"], r.total) for r in running(df, ["g"], [F.col("s").desc(), F.col("k")], {"total": F.col("v")}).collect()}
    for g in ("a", "b", None):
        total = 0
        for i, (_, _, k, v) in enumerate(sorted((x for x in data if x[0] == g), key=lambda x: (-x[1], x[2])), 1):
            total += v
            assert found[k] == (i, total)
    assert running(df.limit(0), ["g"], [F.col("k")], {}).count() == 0
    assert sorted(r["rank"] for r in shuffled(df, [], "k", 1).collect()) == list(range(1, 401))


def test_samples(spark):
    df = rows(spark)
    found = stratified_sample(df, "row_id", "label", 100).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in found} == {None: 7, "AI-Generated": 33, "Real": 33}
    assert stratified_sample(df, "row_id", "label", 0).count() == 500
    assert {r.label: r["count"] for r in balanced_slice(df, "row_id", "label", 64).groupBy("label").count().collect()} == {"Real": 32, "AI-Generated": 32}
    assert balanced_slice(df, "row_id", "label", 0).count() == 0
    for bad in (63, 4000):
        with pytest.raises(ValueError):
            balanced_slice(df, "row_id", "label", bad)
    turns = interleave(df.where("label is not null"), "row_id", "label").orderBy("round", "label").limit(20).collect()
    assert [r.label for r in turns] == ["AI-Generated", "Real"] * 10


def test_task_mix(spark):
    found = {r.t: r["count"] for r in spark.range(20000).select(task_pick(F.col("id"), 1, 2).alias("t")).groupBy("t").count().collect()}
    assert abs(found["final_json"] - 8000) < 300 and abs(found["consistency_check"] - 2000) < 200
    assert {r[0] for r in spark.range(10).select(task_pick(F.col("id"), 1, 2, {"a": 1.0, "b": -5.0})).collect()} == {"a"}


def test_checkpoints(spark):
    df = spark.createDataFrame([("b", 0.6, 0.5, None, 0.4, 0.4), ("a", 0.6, 0.5, None, 0.4, 0.4), ("c", None, 0.9, 0.9, 0.9, 0.9)], "path string, overall_accuracy double, overall_macro_f1 double, json_parse_rate double, rouge_l double, meteor double")
    assert [r.path for r in ranked_reports(df).orderBy("rank").collect()] == ["a", "b", "c"]
    names = spark.createDataFrame([("checkpoint-9",), ("checkpoint-10",), ("other",)], "n string")
    assert latest_checkpoint(names, "n").first().n == "checkpoint-10"


def test_select_rows(spark):
    from tesselade.operators.splits import select_rows

    df = rows(spark, 20)
    held = spark.createDataFrame([(1,), (5,), (5,), (30,)], "row_id bigint")
    ids = spark.createDataFrame([("5",), ("6",)], "id string")
    keys = lambda found: sorted(r.row_id for r in found.collect())
    assert keys(select_rows(df, "row_id", split=held)) == [1, 5]
    assert keys(select_rows(df, "row_id", ids=ids, first=1)) == [5, 6]
    assert keys(select_rows(df, "row_id", split=held, ids=ids)) == [5]
    assert keys(select_rows(df, "row_id", first=3)) == [0, 1, 2] and select_rows(df, "row_id").count() == 20
