"""Splits, samples and slices with exact quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselade.dims import FAKE, REAL, TASK_MIX
from tesselade.operators.ranking import shuffled


def eval_quota(count: Column, ratio: float) -> Column:
    """Half-even rounding, at least one and not all; one row goes to eval."""
    return F.when(count <= 1, count).otherwise(F.greatest(F.lit(1), F.least(count - 1, F.bround(count * F.lit(float(ratio))).cast("bigint"))))


def stratified_split(df: DataFrame, key: str, label: str, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``split``: eval or train, by quota within each label."""
    ranked = shuffled(df, [label], key, seed)
    quota = df.groupBy(F.col(label).alias("_label")).agg(eval_quota(F.count("*"), ratio).alias("_quota"))
    rows = ranked.join(quota, F.col(label).eqNullSafe(F.col("_label")))
    return rows.select(*df.columns, F.when(F.col("rank") <= F.col("_quota"), "eval").otherwise("train").alias("split"))


def stratified_sample(df: DataFrame, key: str, label: str, size: int, seed: int = 42) -> DataFrame:
    """An equal quota for each label, the remainder to the first ones.

    A size of 0 or less, or of all rows, keeps everything; short labels are
    not made up for by others.
    """
    counts = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    labels = [r["_label"] for r in counts.select("_label").orderBy("_label").collect()]  # as many as labels
    total = counts.agg(F.sum("_n")).first()[0] or 0
    if size <= 0 or size >= total or not labels:
        return df
    each, rest = divmod(size, len(labels))
    place = F.array_position(F.array(*[F.coalesce(F.lit(x), F.lit("")) for x in labels]), F.coalesce(label, F.lit("")))
    ranked = shuffled(df, [label], key, seed)
    return ranked.where(F.col("rank") <= F.lit(each) + (place <= rest).cast("int")).select(*df.columns)


def interleave(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Adds ``round``: ordered by (round, label), labels take turns."""
    return shuffled(df, [label], key, seed).withColumnRenamed("rank", "round")


def balanced_slice(df: DataFrame, key: str, label: str, size: int, seed: int = 42) -> DataFrame:
    """Half of ``size`` from each of Real and AI-Generated.

    An odd size or too few rows of a class raise; 0 or less gives no rows.
    """
    if size <= 0:
        return df.limit(0)
    if size % 2:
        raise ValueError("a balanced slice has an even number of rows")
    rows = df.where(F.col(label).isin(REAL, FAKE))
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}  # two rows at most
    if short := {c: counts.get(c, 0) for c in (REAL, FAKE) if counts.get(c, 0) < size // 2}:
        raise ValueError(f"too few rows for a balanced slice of {size}: {short}")
    return shuffled(rows, [label], key, seed).where(F.col("rank") <= size // 2).select(*df.columns)


def task_pick(key: Column, seed: int, epoch: int, mix: dict[str, float] = TASK_MIX) -> Column:
    """One of the tasks by weight, from a hash of seed, epoch and key.

    Negative weights count as 0.
    """
    weights = {t: max(0.0, w) for t, w in mix.items()}
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("no task has a weight")
    digest = F.md5(F.concat(F.lit(f"{seed + epoch * 1000003}:"), key.cast("string")))
    uniform = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    picked, upto = F.lit(None).cast("string"), 0.0
    bounds = []
    for t, w in weights.items():
        upto += w / total
        bounds.append((t, upto))
    picked = F.lit(bounds[-1][0])
    for t, b in reversed(bounds[:-1]):
        picked = F.when(uniform < b, t).otherwise(picked)
    return picked


def row_summary(df: DataFrame, key: str, label: str) -> DataFrame:
    """One row: rows, smallest and largest key, checksum, label counts."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"), F.sum(F.col(key).cast("decimal(38,0)")).alias("sum"))
    return counts.agg(
        F.sum("n").alias("dataset_rows"), F.min("lo").alias("row_id_min"), F.max("hi").alias("row_id_max"), F.sum("sum").cast("bigint").alias("row_id_checksum"),
        F.array_sort(F.collect_list(F.concat_ws("=", F.coalesce(label, F.lit("null")), F.col("n").cast("string")))).alias("label_counts"),
    )


def same_summary(left: dict, right: dict) -> bool:
    """A stored split may be reused: same seed, ratio and dataset."""
    return left.get("seed") == right.get("seed") and abs(left.get("eval_ratio", 0) - right.get("eval_ratio", 0)) < 1e-12 and left.get("source_dataset") == right.get("source_dataset")


def select_rows(df: DataFrame, key: str, split: DataFrame | None = None, ids: DataFrame | None = None, first: int = 0) -> DataFrame:
    """Rows of a split, of a list of ids, or the first ones in key order.

    ``split`` and ``ids`` are tables whose first column holds keys; ids are
    compared as text. ``first`` counts only where no ids are given.
    """
    if split is not None:
        df = df.join(split.select(F.col(split.columns[0]).alias(key)).distinct(), key, "left_semi")
    if ids is not None:
        wanted = ids.select(F.col(ids.columns[0]).cast("string").alias("_id")).distinct()
        return df.join(wanted, F.col(key).cast("string") == F.col("_id"), "left_semi")
    return df.orderBy(key).limit(first) if first > 0 else df
