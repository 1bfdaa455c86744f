"""Writers: JSON lines, manifests, reports and quarantined rows."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselade.operators.splits import row_summary, same_summary, stratified_split


def json_line(df: DataFrame) -> DataFrame:
    """Rows as one JSON text each; nulls are written out."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    json_line(df).write.mode(mode).text(path)


def write_json(value: dict, path: str) -> None:
    """A small report, in place at once or not at all."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, default=str)
        f.write("\n")
    os.replace(f"{path}.part", path)


def manifest(df: DataFrame, label: str, flags: str, example: str) -> dict:
    """Rows, label counts, flags, fields and the first row of a derived build."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size(flags), F.lit(0))).alias("f")).collect()  # as many rows as labels
    first = df.orderBy(example).limit(1).collect()
    return {
        "rows": sum(r["n"] for r in counts),
        "label_counts": {str(r[label]): r["n"] for r in sorted(counts, key=lambda r: str(r[label]))},
        "quality_flags": sum(r["f"] for r in counts),
        "fields": df.columns,
        "example": first[0].asDict(recursive=True) if first else None,
    }


def split_manifest(df: DataFrame, key: str, label: str, folder: str, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """(key, label, split), stored in ``folder`` and reused while it fits.

    The stored split is taken again if seed, ratio and the summary of the
    dataset are the same; the ids stay a table, only the summary is JSON.
    """
    summary = row_summary(df, key, label).first().asDict()
    want = {"seed": seed, "eval_ratio": ratio, "source_dataset": summary}
    report = os.path.join(folder, "split.json")
    rows = os.path.join(folder, "rows.parquet")
    if os.path.exists(report):
        with open(report, encoding="utf-8") as f:
            if same_summary(json.load(f), want):
                return df.sparkSession.read.parquet(rows)
    stratified_split(df.select(key, label), key, label, ratio, seed).write.mode("overwrite").parquet(rows)
    write_json(want, report)
    return df.sparkSession.read.parquet(rows)


def quarantine(df: DataFrame, name: str, text: str, path: str) -> None:
    """Raw model texts that failed, under a name that is safe in any file system."""
    safe = F.regexp_replace(F.col(name), "[^A-Za-z0-9._-]+", "_")
    df.select(safe.alias("name"), F.col(text).alias("raw")).write.mode("append").parquet(path)


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def materialise_images(members: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Writes (member, bytes) below ``folder/images``; existing files stay.

    ``folder`` must be one that all executors share. A file appears whole or
    not at all, so a retried task does no harm.
    """

    def save(rows) -> None:
        for r in rows:
            path = os.path.join(folder, "images", r["member"])
            if not os.path.normpath(path).startswith(os.path.normpath(os.path.join(folder, "images")) + os.sep):
                raise ValueError(f"outside of the folder: {r['member']}")
            if os.path.exists(path) and not overwrite:
                continue
            os.makedirs(os.path.dirname(path), exist_ok=True)
            part = f"{path}.{os.getpid()}.part"
            with open(part, "wb") as f:
                f.write(r["bytes"])
            os.replace(part, path)

    members.select("member", "bytes").foreachPartition(save)
