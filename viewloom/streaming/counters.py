"""Incremental forms over a stream of events: windowed engagement counts with late data, latest version per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def engagement(events: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, user_id, n_events, value_sum) per tumbling window; events later than ``late`` behind the newest are dropped.

    Works on a batch table and on a stream.
    """
    t = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        t = t.withWatermark(time, late)
    g = t.groupBy(F.window(time, window).alias("w"), "user_id").agg(F.count("*").alias("n_events"), F.sum("value").alias("value_sum"))
    return g.select(F.col("w.start").alias("window_start"), "user_id", "n_events", "value_sum")


def latest(events: DataFrame, key: str, version: str) -> DataFrame:
    """The largest version seen per key; on a stream to be written in update mode."""
    return events.groupBy(key).agg(F.max(version).alias(version))
