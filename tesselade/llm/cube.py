"""Balanced samples with planned category counts, by the cube method.

Every unit of a category starts with the inclusion probability target / count,
kept as a whole number of parts of the count, so that no rounding can unbalance
a sample. The balancing variables are the category indicators. A direction of
the flight is a vector in their kernel: among units of one category it moves
probability from one to another and leaves every count as it is. A flight runs
over each of ``PARTS`` parts in random order and holds one open unit a line of a plan;
what stays open merges upward, up to ``FAN`` partitions at a time, until one
open unit a line is left at most. With whole targets its probability has then
become 0 or 1; for others the landing draws it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselade.operators.joins import salted_join
from tesselade.session import first_delivery, materialise

PARTS = 4096  # parts by key in which the first flights run, however the rows are stored
FAN, LEVELS = 64, 3  # partitions that merge into one, and how often; the last level merges all that is left
MAX_PLAN_LINES = 100_000  # plan lines that are broadcast; more are joined by shuffle, hot categories split


def _draw(seed: int, plan: int, a, b) -> float:
    """A uniform number that depends on the meeting units alone."""
    return xxhash.xxh3_64_intdigest(f"{seed}|{plan}|{a}|{b}") / 2.0**64


def meet(open_mass: int, mass: int, whole: int, u: float) -> tuple[int, int]:
    """New masses of two units of one category: a step along the kernel.

    One of them ends at 0 or ``whole``; each keeps its expectation.
    """
    total = open_mass + mass
    if total <= whole:  # one is dropped, the other carries both
        return (total, 0) if u * total < open_mass else (0, total)
    rest = total - whole  # one is taken, the other keeps the rest
    return (whole, rest) if u * (2 * whole - total) < whole - mass else (rest, whole)


_COLUMNS = ["plan_id", "category", "key", "mass", "whole", "at", "chosen"]


def _flight(batches: Iterator[pd.DataFrame], seed: int, land: bool) -> Iterator[pd.DataFrame]:
    """Let units meet within (plan, category, at); chosen ones pass through."""
    waiting: dict[tuple, tuple] = {}
    for pdf in batches:
        done: list[tuple] = []
        for plan, category, key, mass, whole, at, chosen in pdf[_COLUMNS].itertuples(index=False, name=None):
            if chosen or mass >= whole:
                done.append((plan, category, key, whole, whole, at, True))
                continue
            line = (plan, category, at)
            other = waiting.pop(line, None)
            if other is None:
                waiting[line] = (key, mass, whole)
                continue
            mine, theirs = meet(mass, other[1], whole, _draw(seed, plan, key, other[0]))
            for k, m in ((key, mine), (other[0], theirs)):
                if m == whole:
                    done.append((plan, category, k, whole, whole, at, True))
                elif m > 0:
                    waiting[line] = (k, m, whole)
        yield pd.DataFrame(done, columns=_COLUMNS)
    left = [(plan, category, key, mass, whole, at, land and _draw(seed, plan, key, "landing") * whole < mass) for (plan, category, at), (key, mass, whole) in waiting.items()]
    yield pd.DataFrame([x for x in left if x[-1] or not land], columns=_COLUMNS)


def plan_lines(plans: DataFrame, records: DataFrame) -> DataFrame:
    """Target and available records of each line of each plan.

    The target is the larger of ``min_rows`` and ``target_share x
    sample_rows`` to the nearest whole number; a null counts as 0. A category
    given twice in a plan keeps its larger target.
    """
    share = F.round(F.col("target_share") * F.col("sample_rows")).cast("bigint")
    target = F.greatest(F.coalesce("min_rows", F.lit(0)), F.coalesce(share, F.lit(0)), F.lit(0).cast("bigint"))
    lines = plans.groupBy("plan_id", "category").agg(F.max("sample_rows").alias("sample_rows"), F.max("target_share").alias("target_share"), F.max("min_rows").alias("min_rows"), F.max(target).alias("target"))
    available = records.groupBy("category").agg(F.count("*").alias("available"))
    return lines.join(available, "category", "left").withColumn("available", F.coalesce("available", F.lit(0).cast("bigint")))


def balanced_sample(df: DataFrame, key: str, category: str, plans: DataFrame, order: str | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(sample, report) for all plans at once.

    sample: plan_id, key, category. report: a line a plan and category with
    target, available, drawn, shortfall and imbalance (share drawn in the plan
    less the target share; null where nothing was drawn). A line draws its
    target or, if there are fewer, all records of the category: minimums go
    before ``sample_rows``. Records delivered again count once; a null
    category is in no plan, rows without key are left out. Plans without
    records and empty plans give lines with nothing drawn.
    """
    records = materialise(first_delivery(df, key, [F.col(category).alias("category")], order))
    lines = materialise(plan_lines(plans, records))
    open_lines = lines.where("target > 0 and available > 0").select("plan_id", "category", F.least("target", "available").alias("mass"), F.col("available").alias("whole"))
    if lines.limit(MAX_PLAN_LINES + 1).count() <= MAX_PLAN_LINES:
        units = records.withColumnRenamed(key, "key").join(F.broadcast(open_lines), "category")
    else:
        units = salted_join(records.withColumnRenamed(key, "key"), open_lines, ["category"])
    at = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(PARTS)).cast("int")
    units = units.select("plan_id", "category", "key", "mass", "whole", at.alias("at"), F.lit(False).alias("chosen"))
    schema = f"plan_id {dict(plans.dtypes)['plan_id']}, category string, key {dict(units.dtypes)['key']}, mass bigint, whole bigint, at int, chosen boolean"
    shuffled = units.repartition("at").sortWithinPartitions("at", F.xxhash64("key", F.lit(seed)), "key", "plan_id")
    flown = materialise(shuffled.mapInPandas(lambda batches: _flight(batches, seed, False), schema))
    merged = flown.where("not chosen")
    for level in range(1, LEVELS + 1):
        last = level == LEVELS
        merged = merged.withColumn("at", F.lit(0) if last else F.floor(F.col("at") / FAN).cast("int"))
        merged = merged.repartition("plan_id", "category", "at").sortWithinPartitions("plan_id", "category", "at", F.xxhash64("key", F.lit(seed + level)), "key")
        merged = merged.mapInPandas(lambda batches, last=last: _flight(batches, seed, last), schema)
    sample = flown.where("chosen").union(merged.where("chosen")).select("plan_id", F.col("key").alias(key), "category")
    drawn = sample.groupBy("plan_id", "category").agg(F.count("*").alias("drawn"))
    report = lines.join(drawn, ["plan_id", "category"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0).cast("bigint")))
    totals = report.groupBy("plan_id").agg(F.sum("drawn").alias("_all"))
    report = report.join(totals, "plan_id").select(
        "plan_id", "category", "sample_rows", "target_share", "min_rows", "target", "available", "drawn", (F.col("target") - F.col("drawn")).alias("shortfall"),
        F.when(F.col("_all") > 0, F.col("drawn") / F.col("_all") - F.col("target_share")).alias("imbalance"),
    )
    return sample, report
