"""Monitoring of runs as their steps arrive (an extension: batch prefix operators are the reference semantics)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame) -> DataFrame:
    """Event times without a zone are read in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_error_rate(events: DataFrame, watermark: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Error rate by run and event-time window; steps later than the watermark are left out."""
    w = _timed(events).withWatermark("ts", watermark).groupBy(F.window("ts", window), "user_id")
    return w.agg(F.avg((F.col("event_type") == "error").cast("double")).alias("error_rate"), F.count(F.lit(1)).alias("steps"))


def session_features(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 day") -> DataFrame:
    """One row for each session of a user: its steps and errors, emitted when the watermark passes its end."""
    s = _timed(events).withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), "user_id")
    return s.agg(F.count(F.lit(1)).alias("steps"), F.sum((F.col("event_type") == "error").cast("long")).alias("errors"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there, append it, stop; a restart goes on where this ended."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
