"""Readers: JSON lines, id lists, reports, prompts, archives and images."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CRITERION = "criterion:string,evidence:string"
SOURCE_SCHEMA = "images array<string>, query string, response string"
DRAFT = "array<struct<criterion:string,proposed_score:int,evidence:string,support_type:string,holmes_span:string,artifact_score_conflict:boolean,non_applicable:boolean>>"
DERIVED_SCHEMA = (
    "row_id bigint, image string, image_root string, source string, original_query string, original_response string, step1_target string,"
    f"final_json_target struct<per_criterion:array<struct<{_CRITERION},`aigc score`:int>>,overall_likelihood:string>,"
    f"evidence_trace_target struct<overall_likelihood:string,per_criterion:array<struct<criterion:string,score:int,evidence:string,support_type:string,holmes_span:string,artifact_taxonomy:string,non_applicable:boolean,artifact_score_conflict:boolean>>>,"
    "taxonomy_target struct<overall_likelihood:string,per_criterion:array<struct<criterion:string,artifact_taxonomy:string,support_type:string>>>,"
    "consistency_target struct<overall_consistent:boolean,expected_overall_likelihood:string,per_criterion:array<struct<criterion:string,consistent:boolean,reason:string>>>,"
    "quality_flags array<string>"
)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, position: str | None = None) -> DataFrame:
    """One object a line, blank lines skipped.

    ``position`` names a column with the place of the row among the non-blank
    lines, files in order of their paths: lines are numbered within their split
    and shifted by the counts of the splits before.
    """
    if position is None:
        return spark.read.schema(schema).json(path)
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    lines = text.where(F.trim("value") != "")
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    shifts = lines.groupBy("_f", "_b").agg(F.count("*").alias("_n")).select("_f", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    numbered = lines.withColumn("_r", F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_i"))).join(shifts, ["_f", "_b"])
    return numbered.select((F.col("_s") + F.col("_r") - 1).cast("bigint").alias(position), F.from_json("value", schema).alias("r")).select(position, "r.*")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id STRING): a JSON list, or one id a line. A missing file raises."""
    if path.endswith(".json"):
        whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("ids"))
        ids = whole.select(F.explode("ids").alias("id"))
    else:
        ids = spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")
    return ids.distinct()


def read_epoch_reports(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Reports ``epoch_*.json`` of a folder with their path."""
    return spark.read.schema(schema).option("multiLine", True).json(os.path.join(folder, "epoch_*.json")).withColumn("path", F.col("_metadata.file_name"))


def read_prompts(folder: str, names: dict[str, str]) -> dict[str, str]:
    """Named prompts from ``<name>.txt``, the given text where a file is missing."""
    found = {}
    for name, otherwise in names.items():
        path = os.path.join(folder, f"{name}.txt")
        found[name] = open(path, encoding="utf-8").read().strip() if os.path.exists(path) else otherwise
    return found


def dataset_path(path: str) -> str:
    """A file as it is; of a folder ``derived.jsonl``, else ``train.jsonl``."""
    if os.path.isfile(path):
        return path
    for name in ("derived.jsonl", "train.jsonl"):
        if os.path.exists(os.path.join(path, name)):
            return os.path.join(path, name)
    raise FileNotFoundError(f"no dataset in {path}")


def zip_members(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(archive, member[, bytes]) of the files in the archives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, raw in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for m in z.infolist():
                        if not m.is_dir():
                            yield pd.DataFrame({"archive": [archive], "member": [m.filename], "bytes": [z.read(m) if content else None]})

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, bytes binary")
    return found if content else found.drop("bytes")


def image_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, class, bytes): the class is the directory of the image."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("class"), F.col("content").alias("bytes"))


def decoded(df: DataFrame, column: str = "bytes", side: int = 1024) -> DataFrame:
    """Adds width, height and ok of an image after shrinking to ``side``.

    Needs Pillow; an image that can't be read counts as a black 224 x 224 one.
    """

    @F.pandas_udf("width int, height int, ok boolean")
    def size(raw: pd.Series) -> pd.DataFrame:
        from PIL import Image

        out = []
        for r in raw:
            try:
                image = Image.open(io.BytesIO(r)).convert("RGB")
                image.thumbnail((side, side), Image.Resampling.LANCZOS)
                out.append((*image.size, True))
            except Exception:  # noqa: BLE001
                out.append((224, 224, False))
        return pd.DataFrame(out, columns=["width", "height", "ok"])

    return df.withColumn("_size", size(column)).select(*df.columns, "_size.*")


def scored(df: DataFrame, scorer: Callable[[], Callable[[pd.DataFrame], pd.Series]], out: str = "detector_score") -> DataFrame:
    """Adds scores of a pluggable model.

    ``scorer`` is called once a Python worker and returns a function from a
    batch to its scores. A batch that fails is retried a row at a time; rows
    that fail alone get null.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for pdf in batches:
            try:
                values = list(score(pdf))
            except Exception:  # noqa: BLE001
                values = []
                for i in range(len(pdf)):
                    try:
                        values.append(float(next(iter(score(pdf.iloc[i : i + 1])))))
                    except Exception:  # noqa: BLE001
                        values.append(None)
            yield pdf.assign(**{out: values})

    return df.mapInPandas(run, schema)
