"""Classification, threshold and text metrics."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesselade.operators.ranking import running

CONFUSION = ("tp", "tn", "fp", "fn")


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def confusion(gold: Column, predicted: Column) -> list[Column]:
    hit = lambda g, p, name: F.count_if((gold == g) & (predicted == p)).alias(name)
    return [hit(1, 1, "tp"), hit(0, 0, "tn"), hit(0, 1, "fp"), hit(1, 0, "fn")]


def from_confusion(df: DataFrame) -> DataFrame:
    """Adds the rates that the four counts give."""
    tp, tn, fp, fn = map(F.col, CONFUSION)
    return df.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + tn + fp + fn),
            "macro_f1": (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2,
            "real_recall": ratio(tn, tn + fp),
            "fake_recall": ratio(tp, tp + fn),
            "real_false_positive_rate": ratio(fp, tn + fp),
            "pred_fake_count": tp + fp,
            "pred_real_count": tn + fn,
        }
    )


def binary_metrics(df: DataFrame, group: list[str], gold: str, score: str, threshold: Column) -> DataFrame:
    """Counts and rates of each group at its threshold; the threshold counts as positive."""
    predicted = F.when(F.col(score) >= threshold, 1).otherwise(0)
    return from_confusion(df.groupBy(*group).agg(*confusion(F.col(gold), predicted)))


def average_precision(df: DataFrame, group: list[str], gold: str, score: str, key: str) -> DataFrame:
    """Mean precision at the positives, in falling order of score, ties by key.

    0 where a group has no positive.
    """
    ranked = running(df, group, [F.col(score).desc(), F.col(key)], {"positives": F.col(gold)})
    precision = F.when(F.col(gold) == 1, F.col("positives") / F.col("rank"))
    return ranked.groupBy(*group).agg(ratio(F.sum(precision), F.sum(gold)).alias("average_precision"))


def threshold_sweep(df: DataFrame, group: list[str], gold: str, score: str, low: int = 5, high: int = 95) -> DataFrame:
    """Counts and rates of each group at each of the thresholds low/100 ... high/100.

    Scores are counted by the last threshold they reach before any threshold is
    looked at, so the sweep works on at most ``high - low + 2`` cells a group.
    """
    guess = F.floor(F.col(score) * 100).cast("int")
    step = F.when(F.col(score) >= (guess + 1) / 100, guess + 1).when(F.col(score) < guess / 100, guess - 1).otherwise(guess)
    cells = df.groupBy(*group, F.least(F.greatest(step, F.lit(low - 1)), F.lit(high)).alias("_cell")).agg(F.count_if(F.col(gold) == 1).alias("_p"), F.count_if(F.col(gold) == 0).alias("_n"))
    packed = cells.groupBy(*group).agg(F.collect_list(F.struct("_cell", "_p", "_n")).alias("_cells"))
    rows = packed.select(*group, "_cells", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("step"))
    over = lambda field, holds: F.aggregate(F.filter("_cells", holds), F.lit(0).cast("bigint"), lambda a, c: a + c[field])
    above, below = lambda c: c["_cell"] >= F.col("step"), lambda c: c["_cell"] < F.col("step")
    rows = rows.select(*group, (F.col("step") / 100).alias("threshold"), over("_p", above).alias("tp"), over("_n", below).alias("tn"), over("_n", above).alias("fp"), over("_p", below).alias("fn"))
    return from_confusion(rows)


def best_threshold(sweep: DataFrame, group: list[str]) -> DataFrame:
    """Best macro-F1, then accuracy, then nearest to 0.5, then lowest."""
    rank = F.struct("macro_f1", "accuracy", -F.abs(F.col("threshold") - 0.5), -F.col("threshold"))
    fields = ["threshold", "macro_f1", "accuracy", *CONFUSION]
    return sweep.groupBy(*group).agg(F.max_by(F.struct(*fields), rank).alias("_b")).select(*group, "_b.*")


def bleu_1(reference: list[str], hypothesis: list[str]) -> float:
    """Clipped unigram precision times the brevity penalty."""
    if not reference or not hypothesis:
        return 0.0
    shared = sum((Counter(reference) & Counter(hypothesis)).values())
    return shared / len(hypothesis) * min(1.0, math.exp(1 - len(reference) / len(hypothesis)))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, bit-parallel over a."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    rest = full = (1 << len(a)) - 1
    for w in b:
        hit = rest & places.get(w, 0)
        rest = ((rest + hit) | (rest - hit)) & full
    return len(a) - rest.bit_count()


def rouge_l(reference: list[str], hypothesis: list[str]) -> float:
    """F1 of the longest common subsequence."""
    total = len(reference) + len(hypothesis)
    return 2 * lcs_length(reference, hypothesis) / total if reference and hypothesis else 0.0


def meteor(reference: list[str], hypothesis: list[str]) -> float:
    """Exact matches, the n-th use of a word with its n-th place, and a chunk penalty."""
    free: dict[str, list[int]] = {}
    for i in range(len(reference) - 1, -1, -1):
        free.setdefault(reference[i], []).append(i)
    matched = [free[w].pop() for w in hypothesis if free.get(w)]
    if not matched:
        return 0.0
    m = len(matched)
    precision, recall = m / len(hypothesis), m / len(reference)
    chunks = 1 + sum(b != a + 1 for a, b in zip(matched, matched[1:]))
    return (1 - 0.5 * (chunks / m) ** 3) * 10 * precision * recall / (recall + 9 * precision)


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("bleu_1", "rouge_l", "meteor")]))
def text_scores(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """All three scores of token arrays, an Arrow batch at a time."""
    pairs = [([] if r is None else list(r), [] if h is None else list(h)) for r, h in zip(reference, hypothesis)]
    return pd.DataFrame({f.__name__: [f(r, h) for r, h in pairs] for f in (bleu_1, rouge_l, meteor)}, dtype="float64")


def probe_accuracies(df: DataFrame, gold: str, probes: dict[str, str]) -> DataFrame:
    """One row: for each probe the rows it predicted, the share it parsed and its accuracy.

    A probe is another prediction of the same rows: of a blank image, of the
    next row's image, or from the gold trace. A null prediction didn't parse.
    """
    cells = []
    for name, column in probes.items():
        said = F.col(column)
        cells += [ratio(F.count(said), F.count("*")).alias(f"{name}_parse_rate"), ratio(F.count_if(said == F.col(gold)), F.count("*")).alias(f"{name}_accuracy")]
    return df.agg(F.count("*").alias("samples"), *cells)
