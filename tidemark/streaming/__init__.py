"""Bars and duplicates on a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Bars of a stream (series_id, ts, event_id, value); a bar is final when the watermark passes it."""
    at = F.struct("ts", "event_id")
    bars = ticks.withWatermark("ts", late).groupBy("series_id", F.window("ts", f"{minutes} minutes").alias("w"))
    made = bars.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"))
    return made.select("series_id", F.col("w.start").alias("timestamp"), F.col("w.end").alias("bar_close"), "open", "high", "low", "close")


def stream_first(ticks: DataFrame, key: list[str], late: str = "10 minutes") -> DataFrame:
    """Rows of a stream without repeats of a key inside the watermark."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)
