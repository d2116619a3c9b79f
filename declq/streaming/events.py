"""Extension beyond the declarative queries: event-time windows over a stream of the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """events.parquet of a folder as a stream."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events*").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a zoned type


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value per tumbling window and type; later events than the watermark are dropped."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a user: events that follow each other within a gap."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
