"""Structured Streaming: autosave and rate windows over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def rate_windows(events: DataFrame, length: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Requests per user and fixed window; events later than the watermark are not counted."""
    w = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", length).alias("w")).agg(F.count("*").alias("requests"))
    return w.select("user_id", F.col("w.start").alias("window_start"), "requests")


def latest_answers(events: DataFrame) -> DataFrame:
    """Last write wins per attempt and field, by event time and then id: for `update` or
    `complete` output.  max_by keeps one row of state a key, for ever: for attempts that end, use
    `answers.current_answers` with a limit."""
    last = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id"))
    return events.groupBy("user_id", "event_type").agg(last.alias("last")).select("user_id", "event_type", "last.event_id", "last.value")
