"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once a context.

    Workers import it by name, and neither their working folder nor an
    installation on every host can be relied on.
    """
    context = spark.sparkContext
    if getattr(context, "_tesselade_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tesselade-"), "tesselade.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(home):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("tesselade", os.path.relpath(path, home)))
    context.addPyFile(archive)
    context._tesselade_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_folder(spark: SparkSession) -> None:
    """See that checkpoints have a folder that all executors share.

    ``spark.checkpoint.dir`` names it. Only a local session, whose executors run
    on this machine, gets a folder of its own, removed when Python ends.
    """
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() is not None:
        return
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tesselade-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    Spark removes the files of a checkpoint that nothing refers to any longer
    if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def first_delivery(df: DataFrame, key: str, payload: list[Column | str], order: str | None = None) -> DataFrame:
    """One row a key: the payload of the earliest delivery.

    Only ``payload`` is shuffled, so callers project it down first. Deliveries
    are ordered by ``order`` (null last), then by a hash of the payload, which
    makes ties repeatable. Rows whose key is null belong to no record and are
    left out.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in payload]
    rows = df.where(F.col(key).isNotNull())
    late = F.col(order).isNull() if order else F.lit(False)
    at = F.col(order) if order else F.lit(0)
    rows = rows.select(F.col(key).alias("_key"), F.struct(*columns).alias("_row"), late.alias("_late"), at.alias("_at"))
    content = F.to_json("_row") if "map<" in dict(rows.dtypes)["_row"] else F.col("_row")  # a map has no hash
    first = rows.groupBy("_key").agg(F.min_by("_row", F.struct("_late", "_at", F.xxhash64(content))).alias("_row"))
    return first.select(F.col("_key").alias(key), "_row.*")
