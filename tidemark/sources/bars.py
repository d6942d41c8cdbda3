"""Reading and cleaning bars, and making bars from ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.schema import ORDER, PART, RAW, SESSION


def scrub(df: DataFrame) -> DataFrame:
    """NaN to null in every floating column: comparisons and aggregates then skip what is missing."""
    kinds = dict(df.dtypes)
    return df.select(*[F.nanvl(F.col(f"`{c}`"), F.lit(None).cast(kinds[c])).alias(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in df.columns])


def keep_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row a key: the first in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def seconds_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def in_session(ts: Column, bounds: tuple[int, int] = SESSION) -> Column:
    """From the opening second to the closing one; fractions beyond the closing second are out."""
    fraction = F.date_format(ts, "SSSSSS").cast("int")
    return (seconds_of_day(ts) * F.lit(1000000).cast("long") + fraction).between(bounds[0] * 1000000, bounds[1] * 1000000)


def number_in_session(df: DataFrame, part: list[str] = PART, ts: str = "timestamp") -> DataFrame:
    """Adds session_date and bar_in_session, which counts from 1."""
    dated = df.withColumn("session_date", F.to_date(ts))
    return dated.withColumn("bar_in_session", F.row_number().over(Window.partitionBy(*part, "session_date").orderBy(ts)))


def read_csv_bars(spark: SparkSession, path: str, zone: str = "Asia/Kolkata", minutes: int = 5, series: str = "csv") -> DataFrame:
    """Clean bars of a CSV file with a header: local time, first of repeated timestamps, session hours only.

    Volume is dropped and rows that break OHLC order are kept; audit() counts both.
    """
    raw = scrub(spark.read.schema(RAW).option("header", True).csv(path)).withColumn("_line", F.monotonically_increasing_id())
    # Instants, shown as the zone's local time without a zone.
    local = raw.withColumn("timestamp", F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_utc_timestamp(F.to_timestamp("timestamp"), F.current_timezone()).cast("timestamp_ntz")))
    clean = keep_first(local.withColumn("series_id", F.lit(series)), ["series_id", "timestamp"], [F.col("_line")]).where(in_session(F.col("timestamp")))
    close = F.col("timestamp") + F.make_dt_interval(mins=F.lit(minutes))
    return number_in_session(clean).select("series_id", "timestamp", close.alias("bar_close"), "open", "high", "low", "close", "session_date", "bar_in_session")


def audit(df: DataFrame, part: list[str] = PART) -> DataFrame:
    """Rows, rows whose high is below or whose low is above the body, and rows with volume if there is any."""
    sums = [F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("high") < F.greatest("open", "close")).alias("n_bad_high"), F.count_if(F.col("low") > F.least("open", "close")).alias("n_bad_low")]
    if "volume" in df.columns:
        sums.append(F.count_if(F.col("volume") != 0).alias("n_volume"))
    return df.groupBy(*part).agg(*sums)


def event_ticks(events: DataFrame) -> DataFrame:
    """The driver's events as ticks: a series for each event type."""
    return scrub(events.select(F.col("event_type").alias("series_id"), "ts", "event_id", "value")).where("value is not null")


def bin_start(ts: Column, minutes: int) -> Column:
    """Start of the bin of the day; minutes divide the day."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    return F.date_trunc("day", ts).cast("timestamp_ntz") + F.make_dt_interval(mins=(minute - minute % minutes).cast("int"))


def tick_bars(ticks: DataFrame, minutes: int, part: list[str] = PART) -> DataFrame:
    """Bars round the clock from ticks (ts, event_id, value); ties in time go by event_id."""
    at = F.struct("ts", "event_id")
    bars = ticks.groupBy(*part, bin_start(F.col("ts"), minutes).alias("timestamp")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close")
    )
    bars = bars.withColumn(ORDER, F.col("timestamp") + F.make_dt_interval(mins=F.lit(minutes)))
    return number_in_session(bars, part)
