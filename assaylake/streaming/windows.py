"""Streams: counts and sums in windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts by window and type. On a stream, rows later than the watermark are left out and state of past windows goes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
