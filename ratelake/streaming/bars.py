"""Streaming twins of the batch bars: windows with watermarks, de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events once each; state goes as the watermark passes."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def bars(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Tumbling bars by type, closed by the watermark."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width), F.col("event_type").alias("symbol"))
        .agg(F.min_by("value", F.struct("ts", "event_id")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count("*").alias("volume"))
        .select("symbol", F.col("window.start").alias("bar_time"), "open", "high", "low", "close", "volume")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: events less than a gap apart."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").alias("start"), "events")
