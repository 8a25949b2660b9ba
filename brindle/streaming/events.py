"""Windowed and sessionised event streams. The same functions take batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, *, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, with the schema of those there."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late) if late and events.isStreaming else events


def windowed(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str | None = "1 hour") -> DataFrame:
    """window_start, event_type, events, total: tumbling (or sliding) windows; rows later than ``late`` are dropped by streams."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    got = _timed(events, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """user_id, session_start, session_end, events: runs of a user's events with no gap of that length."""
    got = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return got.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "events")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once; a stream remembers ids for as long as events may be late."""
    timed = _timed(events, late)
    return timed.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else timed.dropDuplicates(["event_id"])
