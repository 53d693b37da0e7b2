"""Windowed aggregates over event streams; the same functions serve batches.

The reference workflows read finished files only, so these are an addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(folder)


def _late(events: DataFrame, time: str, wait: str | None) -> DataFrame:
    return events.withWatermark(time, wait) if wait and events.isStreaming else events


def tumbling(events: DataFrame, size: str = "1 hour", time: str = "ts", wait: str | None = "10 minutes") -> DataFrame:
    """Count and sum by event type and window."""
    g = _late(events, time, wait).groupBy(F.window(time, size).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", time: str = "ts", wait: str | None = "10 minutes") -> DataFrame:
    g = _late(events, time, wait).groupBy(F.window(time, size, step).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", time: str = "ts", wait: str | None = "10 minutes") -> DataFrame:
    """Sessions of each user, split where nothing happens for the gap."""
    g = _late(events, time, wait).groupBy(F.session_window(time, gap).alias("w"), "user_id")
    return g.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_of_each(events: DataFrame, key: str = "event_id", time: str = "ts", wait: str = "10 minutes") -> DataFrame:
    """Events without repetitions of a key."""
    return events.withWatermark(time, wait).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
