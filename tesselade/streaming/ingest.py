"""Source records as a stream: labelled, de-duplicated, counted by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tesselade.functions import text as X


def read_stream(spark: SparkSession, path: str, schema: StructType | str, files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def first_deliveries(rows: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """The first delivery of each key; keys are forgotten once nothing so late may come."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def label_counts(rows: DataFrame, time: str, label: str, width: str = "1 hour", late: str = "7 days") -> DataFrame:
    """Rows by window and normal label; late rows count until the watermark passes."""
    kept = rows.withWatermark(time, late)
    return kept.groupBy(F.window(time, width).alias("w"), X.normal_label(F.col(label)).alias("label")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "label", "n")


def write_batches(rows: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Each micro-batch as a folder of its own, overwritten on replay: exactly once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
