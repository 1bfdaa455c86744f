from collections import Counter

from pyspark.sql import functions as F

from tesselade.llm.cube import balanced_sample, meet
from tesselade.llm.terms import marked, term_counts

PLAN = "plan_id int, sample_rows bigint, category string, target_share double, min_rows bigint"


def test_meet_keeps_mass_and_expectation():
    for whole in (5, 7):
        for a in range(1, whole):
            for b in range(1, whole):
                second, n = 0.0, 2000
                for i in range(n):
                    x, y = meet(a, b, whole, (i + 0.5) / n)
                    assert x + y == a + b and 0 <= x <= whole and 0 <= y <= whole and (x in (0, whole) or y in (0, whole))
                    second += y
                assert abs(second / n - b) < 0.02 * whole


def test_sample(spark):
    rows = [(i, "a" if i % 3 else "b", 1, "x") for i in range(3000)] + [(5, "a", 2, "again"), (9000, None, 1, "x"), (9001, "rare", 1, "x"), (None, "a", 1, "x")]
    df = spark.createDataFrame(rows, "row_id bigint, category string, at int, mass string").repartition(16)
    plans = spark.createDataFrame([(1, 100, "a", 0.7, 0), (1, 100, "b", 0.3, 0), (2, 10, "rare", 0.5, 3), (2, 10, "none", 0.5, 0), (2, 10, "a", 0.0, 1500), (3, 50, "b", 0.33, 0), (4, None, "a", None, None)], PLAN)
    sample, report = balanced_sample(df, "row_id", "category", plans, "at")
    drawn = sample.collect()
    assert Counter((r.plan_id, r.category) for r in drawn) == {(1, "a"): 70, (1, "b"): 30, (2, "rare"): 1, (2, "a"): 1500, (3, "b"): 17}
    assert len({(r.plan_id, r.row_id) for r in drawn}) == len(drawn)
    truth = {r[0]: r[1] for r in rows}
    assert all(truth[r.row_id] == r.category for r in drawn)
    assert {(r.plan_id, r.category): r.shortfall for r in report.collect() if r.shortfall} == {(2, "rare"): 4, (2, "none"): 5}
    assert {r.row_id for r in balanced_sample(df, "row_id", "category", plans, "at")[0].where("plan_id = 1").collect()} == {r.row_id for r in drawn if r.plan_id == 1}
    other = balanced_sample(df, "row_id", "category", plans, "at", seed=7)[0].where("plan_id = 1").collect()
    assert {r.row_id for r in other} != {r.row_id for r in drawn if r.plan_id == 1}


def test_sample_spreads(spark):
    df = spark.range(4000).select(F.col("id").alias("row_id"), F.lit("a").alias("category"))
    ids = [r.row_id for r in balanced_sample(df, "row_id", "category", spark.createDataFrame([(1, 1000, "a", 1.0, 0)], PLAN))[0].collect()]
    assert len(ids) == 1000 and 330 < sum(i < 1600 for i in ids) < 470


def test_sample_empty(spark):
    df = spark.createDataFrame([], "row_id bigint, category string")
    plans = spark.createDataFrame([(1, 100, "a", 0.7, 0)], PLAN)
    sample, report = balanced_sample(df, "row_id", "category", plans)
    assert sample.count() == 0 and [(r.drawn, r.shortfall, r.imbalance) for r in report.collect()] == [(0, 70, None)]
    assert balanced_sample(df, "row_id", "category", plans.limit(0))[1].count() == 0


def test_terms(spark):
    rows = [(1, ["a", "a", None, ""], 1, "x"), (1, ["a", "a", None, ""], 2, "again"), (2, ["a", "A "], 1, "x"), (3, None, 1, "x"), (4, [], 1, "x"), (None, ["a"], 1, "x")]
    df = spark.createDataFrame(rows, "row_id bigint, tags array<string>, at int, term string")
    counts = term_counts(df, "row_id", {"tags": F.col("tags"), "again": F.col("tags")}, "at")
    found = {(r.field, r.term): (r.occurrences, r.records, r.all_records) for r in counts.collect()}
    assert found == {(f, t): v for f in ("tags", "again") for t, v in {"a": (3, 2, 4), "": (1, 1, 4), "A ": (1, 1, 4)}.items()}
    limits = spark.createDataFrame([("tags", 2, 0.4), ("tags", 1, 0.9), ("none", 1, 0.1), (None, 1, 0.1)], "field string, min_records bigint, max_share double")
    marks = {(r.field, r.term): r.mark for r in marked(counts, limits).collect()}
    assert marks == {("tags", "a"): "common", ("tags", ""): "rare", ("tags", "A "): "rare", ("again", "a"): None, ("again", ""): None, ("again", "A "): None}
    assert term_counts(df.limit(0), "row_id", {"tags": F.col("tags")}).count() == 0


def test_the_sample_does_not_depend_on_partitions(spark, monkeypatch):
    from tesselade.llm import cube

    rows = spark.createDataFrame([(i, "ab"[i % 3 == 0], i) for i in range(500)], "row_id bigint, c string, at int")
    plans = spark.createDataFrame([(1, 40, "a", 0.5, 0), (1, 40, "b", 0.5, 0)], "plan_id int, sample_rows bigint, category string, target_share double, min_rows bigint")
    draw = lambda n: {r.row_id for r in cube.balanced_sample(rows.repartition(n), "row_id", "c", plans)[0].collect()}
    first = draw(1)
    assert len(first) == 40 and draw(7) == first
    monkeypatch.setattr(cube, "MAX_PLAN_LINES", 0)
    assert draw(3) == first
