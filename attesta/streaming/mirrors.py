"""Three batch operators as Structured Streaming queries over an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Files of events as a stream, in UTC timestamps."""
    return spark.readStream.schema(SCHEMA).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once; state older than the watermark goes."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def rolling_counts(events: DataFrame, late: str = "1 hour", size: str = "24 hours", slide: str = "6 hours") -> DataFrame:
    """Events of each type in sliding windows; partial counts are combined before the shuffle."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n")).select("window.start", "window.end", "event_type", "n")


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "6 hours") -> DataFrame:
    """Sessions of each user: events less than ``gap`` apart."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")
