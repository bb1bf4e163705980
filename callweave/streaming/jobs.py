"""Streams: windows, sessions, dedup within a watermark, and an upserting sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import latest


def landed(spark: SparkSession, folder: str, schema: str, per_trigger: int = 64, name: str = "*.parquet") -> DataFrame:
    """New Parquet files of a folder, a bounded number of files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", name).parquet(folder)


def tumbling(events: DataFrame, time: str, keys: list[str], size: str, late: str) -> DataFrame:
    counts = events.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), *keys, "n")


def session_counts(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    counts = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("session_window.start").alias("first"), "n")


def once_within(events: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """The first row of each key; state is dropped when the watermark has passed it."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes all that has landed and stops; restarts go on where the checkpoint says."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_batches(stream: DataFrame, folder: str, checkpoint: str, keys: list[str], order: list[str]) -> None:
    """Each batch's last rows by key go to a folder of its own number, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, keys, order).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, folder: str, keys: list[str], order: list[str]) -> DataFrame:
    """The state that the upserted batches add up to."""
    return latest(spark.read.parquet(folder).drop("batch"), keys, order)


def run_changes(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Each batch's changes go to a folder of its own number, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
