"""Incremental ingestion: file streams, duplicates of overlapping reads, per-key marks, a ledger of what arrived."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: How far a poll reads back before its watermark, how far a first poll, and how far any.
OVERLAP, DEFAULT_LOOKBACK, FLOOR = timedelta(seconds=1800), timedelta(hours=24), timedelta(days=7)


def poll_start(watermark: datetime | None, now: datetime) -> datetime:
    """Where a poll starts: the watermark less the overlap, or the default, but not before the floor."""
    return max(watermark - OVERLAP if watermark else now - DEFAULT_LOOKBACK, now - FLOOR)


def next_watermark(watermark: datetime | None, newest: datetime | None, complete: bool, stored: bool) -> datetime | None:
    """Advances only after a complete poll whose rows were stored, and never goes back."""
    if not (complete and stored and newest):
        return watermark
    return max(watermark, newest) if watermark else newest


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_at_once: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def first_arrivals(stream: DataFrame, keys: list[str], at: str, delay: str = "7 days") -> DataFrame:
    """Rows whose key didn't come within the delay before: what overlapping polls read twice is taken once, with bounded state."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def unknown_only(stream: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key a static table hasn't, whatever its case."""
    seen = known.select(F.lower(key).alias("__k")).distinct()
    return stream.withColumn("__k", F.lower(key)).join(seen, "__k", "left_anti").drop("__k")


def high_marks(rows: DataFrame, key: str, mark: str) -> DataFrame:
    """Per key the largest mark and how many rows came; as a stream, marks_available() merges them."""
    return rows.groupBy(key).agg(F.max(mark).alias("high_mark"), F.count("*").alias("n"))


def marks_available(stream: DataFrame, key: str, mark: str, folder: str, checkpoint: str) -> DataFrame:
    """high_marks() of what is there now: each batch's own marks are written, under the batch's number, and merged where they are read. A batch that is
    repeated takes its own place, and no key is kept on the driver."""

    def put(batch: DataFrame, number: int) -> None:
        high_marks(batch, key, mark).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    parts = stream.sparkSession.read.parquet(folder)
    return parts.groupBy(key).agg(F.max("high_mark").alias("high_mark"), F.sum("n").alias("n"))


def write_available(stream: DataFrame, folder: str, checkpoint: str, partition: str | None = None) -> None:
    """Appends what is there now to Parquet files; a repeated run adds nothing twice (the checkpoint holds what was committed)."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (writer.partitionBy(partition) if partition else writer).start().awaitTermination()


def tumbling_counts(stream: DataFrame, at: str, key: str, size: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """An extension: counts by event-time windows, with late rows taken up to the delay."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
