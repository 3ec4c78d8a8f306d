"""Incremental counts over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_degrees(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, user_id, degree, total): events of each user per window of ``events(ts, user_id, value)``, streaming or not."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    by = events.groupBy(F.window("ts", window).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("degree"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("start"), "user_id", "degree", "total")
