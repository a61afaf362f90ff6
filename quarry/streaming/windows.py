"""Streaming front end: event-time windows with a watermark over arriving events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and values of each kind and window; runs on streams and on tables."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = timed.groupBy(F.window(ts, width), kind).agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), kind, "n_events", "total")


def first_seen(events: DataFrame, key: str, ts: str, late: str = "2 hours") -> DataFrame:
    """Each key of a stream once within the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
