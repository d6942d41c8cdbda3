"""Session-anchored resampling and session audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import ORDER, PART, SESSION
from tidemark.sources.bars import number_in_session, seconds_of_day


def session_bin(ts: Column, minutes: int, opening: int = SESSION[0]) -> Column:
    """Minutes from the opening to the bin's start; raises for bars before it."""
    since = seconds_of_day(ts) - opening
    early = F.raise_error(F.concat(F.lit("bar before the session: "), ts.cast("string")))
    return F.when(since < 0, early.cast("int")).otherwise((F.floor(since / (60 * minutes)) * minutes).cast("int"))


def resample(bars: DataFrame, minutes: int, part: list[str] = PART, last_start: int = 360) -> DataFrame:
    """Bars of a session grouped from its opening; bins that begin last_start minutes in or later are dropped.

    A bar's timestamp is its first constituent's, and it closes `minutes` later.
    """
    binned = bars.withColumn("_bin", session_bin(F.col("timestamp"), minutes))
    if minutes >= 60:
        binned = binned.where(F.col("_bin") < last_start)
    made = binned.groupBy(*part, "session_date", "_bin").agg(
        F.min("timestamp").alias("timestamp"), F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close")
    )
    return number_in_session(made.drop("_bin", "session_date").withColumn(ORDER, F.col("timestamp") + F.make_dt_interval(mins=F.lit(minutes))), part)


def resample_daily(bars: DataFrame, part: list[str] = PART) -> DataFrame:
    """One bar a session, which closes at 15:30."""
    made = bars.groupBy(*part, "session_date").agg(
        F.min("timestamp").alias("timestamp"), F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close")
    )
    close = F.col("session_date").cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(930))
    return made.withColumn(ORDER, close).withColumn("bar_in_session", F.lit(1))


def bars_per_session(bars: DataFrame, part: list[str] = PART) -> DataFrame:
    return bars.groupBy(*part, "session_date").agg(F.count(F.lit(1)).alias("n_bars"))


def session_gaps(bars: DataFrame, minutes: int = 5, part: list[str] = PART) -> DataFrame:
    """Sessions with a step of more than `minutes` between neighbouring bars, and how many."""
    order = Window.partitionBy(*part, "session_date").orderBy("timestamp")
    gap = F.col("timestamp") - F.lag("timestamp").over(order) > F.make_dt_interval(mins=F.lit(minutes))
    return bars.withColumn("_gap", gap).groupBy(*part, "session_date").agg(F.count_if("_gap").alias("n_gaps")).where("n_gaps > 0")
