"""Operators across bar sizes: stratification, confluence scores and asymmetry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import hac_mean, rank_correlations
from tidemark.schema import FLAGS, ORDER, PART, STATES, TIMEFRAMES, flag_column, name_for


def truth(pred: Column) -> Column:
    """What is missing is false."""
    return F.coalesce(pred, F.lit(False))


def score_bull() -> Column:
    return reduce(lambda a, b: a + b, [truth(F.col(flag_column(f)) > 0).cast("int") for f in FLAGS])


def score_bear() -> Column:
    return reduce(lambda a, b: a + b, [truth(F.col(flag_column(f)) < 0).cast("int") for f in FLAGS])


def score_bull_accel() -> Column:
    states = [name_for(f"{i}_state", tf) for i in "AB" for tf in TIMEFRAMES]
    return reduce(lambda a, b: a + b, [truth(F.col(s) == "bull_accel").cast("int") for s in states])


def with_scores(master: DataFrame) -> DataFrame:
    return master.withColumns({"score_bull": score_bull(), "score_bull_accel": score_bull_accel(), "score_bear": score_bear()})


def score_returns(df: DataFrame, score: str, horizons: list[str], lags: int = 12, part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """Statistics by score and horizon for the scores that occur; mean and hit rate from 5 returns, t from 20."""
    long = df.unpivot([F.col(c) for c in [*part, order, score]], [F.col(h) for h in horizons], "horizon", "ret").withColumnRenamed(score, "score")
    return hac_mean(long, [*part, "score", "horizon"], "ret", lags, order, least_mean=5).drop("n_rows")


def stratify(df: DataFrame, setup: Column, state: str, htf_close: str, horizons: list[str], lags: int = 12, part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """Statistics of setup rows by a higher bar size's state, and of all of them as `unconditional`.

    n_htf counts the distinct higher bars. Every group of a series with a setup row
    appears; below five rows the statistics are null.
    """
    picked = df.where(truth(setup))
    group = F.explode(F.array(F.lit("unconditional"), F.col(state)))
    rows = picked.withColumn("group", group).where(F.col("group").isNotNull())
    counts = rows.groupBy(*part, "group").agg(F.count(F.lit(1)).alias("n_5m"), F.count_distinct(htf_close).alias("n_htf"))
    long = rows.unpivot([F.col(c) for c in [*part, "group", order]], [F.col(h) for h in horizons], "horizon", "ret")
    stats = hac_mean(long, [*part, "group", "horizon"], "ret", lags, order)
    spark = df.sparkSession
    grid = spark.createDataFrame([(g, h) for g in (*STATES, "unconditional") for h in horizons], "group string, horizon string")
    # A handful of rows for each series.
    dense = picked.select(*part).distinct().join(F.broadcast(grid)).join(counts, [*part, "group"], "left").join(stats, [*part, "group", "horizon"], "left")
    n = F.coalesce("n_5m", F.lit(0))
    return dense.select(*part, "group", "horizon", n.alias("n_5m"), F.coalesce("n_htf", F.lit(0)).alias("n_htf"), *[F.when(n >= 5, F.col(c)).alias(c) for c in ("mean_ret", "hit_rate", "t_stat", "p_value")])


def asymmetry(bull: DataFrame, bear: DataFrame, part: list[str] = PART) -> DataFrame:
    """Bull against bear tables on the scores and horizons that both have."""
    keys = [*part, "score", "horizon"]
    a = bull.select(*keys, F.col("n").alias("n_bull"), F.col("mean_ret").alias("mean_bull"))
    b = bear.select(*keys, F.col("n").alias("n_bear"), F.col("mean_ret").alias("mean_bear"))
    return a.join(b, keys).withColumn("abs_diff", F.abs("mean_bull") - F.abs("mean_bear"))


def asymmetry_summary(table: DataFrame, part: list[str] = PART) -> DataFrame:
    """By horizon: the mean difference of an asymmetry table, and on how many scores either side was larger."""
    return table.groupBy(*part, "horizon").agg(F.avg("abs_diff").alias("mean_diff"), F.count_if(F.col("abs_diff") > 0).alias("n_bull_larger"), F.count_if(F.col("abs_diff") < 0).alias("n_bear_larger"))


def score_monotonicity(returns: DataFrame, part: list[str] = PART) -> DataFrame:
    """By horizon: Spearman's correlation of score and mean return, over the scores that have a mean."""
    return rank_correlations(returns.select(*part, "horizon", "score", "mean_ret").withColumnRenamed("horizon", "h"), ["score"], ["mean_ret"], [*part, "h"]).select(*part, F.col("h").alias("horizon"), "corr")


def wide(table: DataFrame, keys: list[str], column: str, names: list, value: str) -> DataFrame:
    """A long table with one column for each of the names; cells that do not occur are null."""
    return table.groupBy(*keys).pivot(column, names).agg(F.first(value))


def transition_summary(events: DataFrame, part: list[str] = PART) -> DataFrame:
    """By direction: events, the share that followed through, and the median lag of those."""
    return events.groupBy(*part, "direction").agg(F.count(F.lit(1)).alias("n_events"), F.avg(F.col("followed_through").cast("double")).alias("p_followthrough"), F.median("lag_bars").alias("median_lag_bars"))
