import random

import pytest

from tesselade.operators import metrics as M


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 25))] for _ in range(2))
        assert M.lcs_length(a, b) == lcs(a, b)


def test_text_scores_of_known_pair():
    reference, hypothesis = "a b c d".split(), "a c b".split()
    assert M.bleu_1(reference, hypothesis) == pytest.approx(0.716531, abs=1e-6)
    assert M.rouge_l(reference, hypothesis) == pytest.approx(0.571429, abs=1e-6)
    assert M.meteor(reference, hypothesis) == pytest.approx(0.384615, abs=1e-6)
    assert M.bleu_1([], ["a"]) == M.rouge_l(["a"], []) == M.meteor(["a"], ["b"]) == 0.0


@pytest.mark.parametrize("tp,tn,fp,fn,accuracy,macro,fpr", [(437, 1578, 26, 1167, 0.6281, 0.5743, 0.0162), (1155, 1257, 347, 449, 0.7519, 0.7516, 0.2163)])
def test_published_figures(spark, tp, tn, fp, fn, accuracy, macro, fpr):
    r = M.from_confusion(spark.createDataFrame([(tp, tn, fp, fn)], "tp bigint, tn bigint, fp bigint, fn bigint")).first()
    assert (round(r.accuracy, 4), round(r.macro_f1, 4), round(r.real_false_positive_rate, 4)) == (accuracy, macro, fpr)


def test_average_precision(spark):
    df = spark.createDataFrame([("a", 1, 1, 0.9), ("a", 2, 0, 0.8), ("a", 3, 1, 0.8), ("a", 4, 0, 0.1), ("b", 1, 0, 0.5)], "g string, k int, y int, s double")
    found = {r.g: r.average_precision for r in M.average_precision(df, ["g"], "y", "s", "k").collect()}
    assert found["a"] == pytest.approx(0.833333, abs=1e-6) and found["b"] == 0.0


def test_sweep_against_plain_counts(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xy"), rng.randint(0, 1), rng.choice([0.0, 0.05, 0.29, 0.57, 0.58, 0.95, 1.0, rng.random()])) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    for r in M.threshold_sweep(df, ["g"], "y", "s").collect():
        own = [(y, s >= r.threshold) for g, y, s in rows if g == r.g]
        assert (r.tp, r.tn, r.fp, r.fn) == tuple(sum(x == w for x in own) for w in ((1, True), (0, False), (0, True), (1, False)))
    best = M.best_threshold(M.threshold_sweep(df.where("false"), ["g"], "y", "s"), ["g"])
    assert best.count() == 0


def test_duplicating_rows_keeps_macro_f1(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, 0.3), (0, 0.7)], "y int, s double")
    from pyspark.sql import functions as F

    one, two = (M.binary_metrics(d, [], "y", "s", F.lit(0.5)).first().macro_f1 for d in (df, df.union(df)))
    assert one == two
