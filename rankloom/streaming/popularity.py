"""Popularity kept up to date from a stream of events: an extension of ours, the batch operators don't need it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """event_type, window start and end, n, users (approximate): events later than the watermark are left out."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("users"))
    return out.select("event_type", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "users")
