"""Event studies, runs, peaks and divergences."""

from __future__ import annotations



import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sequence import by, first_within, streak, with_bar_idx
from tidemark.schema import ORDER, PART


def peak_transitions(df: DataFrame, part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """The rows at which a rising advance turns into a slowing one."""
    before = F.lag("A_state").over(by(part, order))
    return df.withColumn("_b", before).where("_b = 'bull_accel' and A_state = 'bull_decel'").drop("_b")


def transition_returns(events: DataFrame, horizons: list[str], part: list[str] = PART) -> DataFrame:
    """Events, mean return by horizon, and the short mean over the long one."""
    means = events.groupBy(*part).agg(F.count(F.lit(1)).alias("n_events"), *[F.avg(h).alias(f"mean_{h}") for h in horizons])
    return means.withColumn("short_vs_long", F.try_divide("mean_ret_fwd_3", F.nullif("mean_ret_fwd_12", F.lit(0.0))))


def aligned_or_tired(df: DataFrame) -> DataFrame:
    """Upward crosses of the line: aligned where histogram and slope are positive, else tired."""
    fits = F.coalesce((F.col("A_hist") > 0) & (F.col("A_hist_slope") > 0), F.lit(False))
    return df.where("A_macd_zero_cross = 1").withColumn("group", F.when(fits, "aligned").otherwise("tired"))


def pullbacks(df: DataFrame) -> DataFrame:
    """Upward crosses of the histogram: with the trend where the line is positive, else against it."""
    return df.where("A_hist_zero_cross = 1").withColumn("group", F.when(F.col("A_macd") > 0, "with_trend").otherwise("counter_trend"))


def zroc_bucket(z: Column) -> Column:
    """baseline up to 0.5 either way, moderate up to 2 on the upper side, extremes beyond 2; between -2 and -0.5 none."""
    return F.when(F.abs(z) <= 0.5, "baseline").when((z > 0.5) & (z <= 2), "moderate").when(z > 2, "extreme_bull").when(z < -2, "extreme_bear")


def bucket_means(df: DataFrame, horizons: list[str], part: list[str] = PART) -> DataFrame:
    rows = df.withColumn("bucket", zroc_bucket(F.col("B_zroc"))).where("bucket is not null")
    return rows.groupBy(*part, "bucket").agg(*[F.avg(h).alias(f"mean_{h}") for h in horizons])


def early_turns(df: DataFrame, bars: int = 3, ahead: int = 20, first_only: bool = False, part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """Rows at which a negative gap has closed for `bars` rows or more, and whether it reaches zero in the next `ahead`."""
    runs = streak(df, (F.col("B_gap") < 0) & (F.col("B_gap_acc") > 0), part, order)
    reached = F.max(F.col("B_gap") >= 0).over(by(part, order).rowsBetween(1, ahead))
    runs = runs.withColumn("confirmed", F.coalesce(reached, F.lit(False)))
    return runs.where(F.col("streak") == bars if first_only else F.col("streak") >= bars)


def early_turn_summary(events: DataFrame, part: list[str] = PART) -> DataFrame:
    """Early turns, those that were confirmed, and the share of false starts."""
    return events.groupBy(*part).agg(F.count(F.lit(1)).alias("n_events"), F.count_if("confirmed").alias("n_confirmed"), F.avg((~F.col("confirmed")).cast("double")).alias("false_start_rate"))


def group_means(events: DataFrame, horizons: list[str], part: list[str] = PART) -> DataFrame:
    """Events and mean returns of each group of an event table."""
    return events.groupBy(*part, "group").agg(F.count(F.lit(1)).alias("n"), *[F.avg(h).alias(f"mean_{h}") for h in horizons])


def at_first_lower_row(events: DataFrame, master: DataFrame, htf_close: str, part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """Events of a higher bar size, moved to the first master row that saw their bar; without one they are left out."""
    first = master.where(F.col(htf_close).isNotNull()).groupBy(*part, F.col(htf_close).alias("_htf")).agg(F.min(order).alias("_first"))
    there = events.withColumnRenamed(order, "_htf").join(first, [*part, "_htf"])
    return there.withColumnRenamed("_first", order).drop("_htf")


def turn_confirmations(df: DataFrame, flip: str, confirm: str, threshold: float = 0.0, bars: int = 20, part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """For each row whose flip is 1 the rows until `confirm` exceeds the threshold, within `bars`."""
    rows = df if "bar_idx" in df.columns else with_bar_idx(df, part, order)
    at = first_within(F.col(confirm) > threshold, bars, by(part, order))
    found = rows.withColumn("bars_to_confirm", (at - F.col("bar_idx")).cast("double")).where(F.col(flip) == 1)
    return found.select(*part, F.col("bar_idx").alias("flip_idx"), F.col("bars_to_confirm").isNotNull().alias("confirmed"), "bars_to_confirm")


def confirmation_summary(events: DataFrame, part: list[str] = PART) -> DataFrame:
    return events.groupBy(*part).agg(
        F.count(F.lit(1)).alias("n_flips"), F.count_if("confirmed").alias("n_confirmed"), F.avg(F.col("confirmed").cast("double")).alias("confirmation_rate"), F.median("bars_to_confirm").alias("median_bars")
    )


def local_maxima(df: DataFrame, col: str, part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """Rows strictly above both neighbours."""
    w = by(part, order)
    rows = df.withColumns({"_b": F.lag(col).over(w), "_n": F.lead(col).over(w)})
    return rows.where((F.col(col) > F.col("_b")) & (F.col(col) > F.col("_n"))).drop("_b", "_n")


def peak_positions(x: np.ndarray, spacing: int) -> np.ndarray:
    """Maxima, plateaus by their middle, of which the highest keep others `spacing` places away."""
    change = np.flatnonzero(np.diff(x) != 0)
    starts, ends = np.concatenate([[0], change + 1]), np.concatenate([change, [len(x) - 1]])
    level = x[starts]
    inner = np.arange(1, len(level) - 1)
    tops = inner[(level[inner] > level[inner - 1]) & (level[inner] > level[inner + 1])]
    at = (starts[tops] + ends[tops]) // 2
    keep = np.ones(len(at), bool)
    for i in np.argsort(x[at], kind="stable")[::-1]:
        if keep[i]:
            near = np.abs(at - at[i]) < spacing
            near[i] = False
            keep[near] = False
    return at[keep]


def local_peaks(df: DataFrame, col: str, spacing: int = 10, part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """(part, bar_idx, kind): highs and lows of each series. Keeping the highest first is sequential, so a series is one group."""
    rows = (df if "bar_idx" in df.columns else with_bar_idx(df, part, order)).select(*part, "bar_idx", F.col(col).cast("double").alias("x"))
    kinds = ", ".join(f"{p} {df.schema[p].dataType.simpleString()}" for p in part)

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx")
        x = pdf["x"].to_numpy(float)
        out = [pd.DataFrame({"bar_idx": pdf["bar_idx"].to_numpy()[peak_positions(s * x, spacing)], "kind": k}) for s, k in ((1, "high"), (-1, "low"))] if len(x) > 2 else []
        made = pd.concat(out) if out else pd.DataFrame({"bar_idx": [], "kind": []})
        return made.assign(**{p: pdf[p].iloc[0] for p in part})[[*part, "bar_idx", "kind"]]

    return rows.groupBy(*part).applyInPandas(find, f"{kinds}, bar_idx int, kind string")


def divergences(df: DataFrame, price: str, indicator: str, spacing: int = 10, part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """Neighbouring peaks at which price and indicator part: (part, peak_idx, confirm_idx, div_type).

    Returns are to be read at confirm_idx, half the spacing later; peaks without that
    row are left out.
    """
    rows = df if "bar_idx" in df.columns else with_bar_idx(df, part, order)
    peaks = local_peaks(rows, price, spacing, part, order)
    values = rows.select(*part, "bar_idx", F.col(price).alias("_p"), F.col(indicator).alias("_i"))
    last = rows.groupBy(*part).agg(F.max("bar_idx").alias("_last"))
    w = Window.partitionBy(*part, "kind").orderBy("bar_idx")
    seen = peaks.join(values, [*part, "bar_idx"]).withColumns({"_p0": F.lag("_p").over(w), "_i0": F.lag("_i").over(w)}).join(last, part)
    kind = F.when((F.col("kind") == "high") & (F.col("_p") > F.col("_p0")) & (F.col("_i") < F.col("_i0")), "bearish").when(
        (F.col("kind") == "low") & (F.col("_p") < F.col("_p0")) & (F.col("_i") > F.col("_i0")), "bullish"
    )
    out = seen.withColumn("div_type", kind).withColumn("confirm_idx", F.col("bar_idx") + spacing // 2)
    return out.where("div_type is not null and confirm_idx <= _last").select(*part, F.col("bar_idx").alias("peak_idx"), "confirm_idx", "div_type")


def divergence_returns(events: DataFrame, df: DataFrame, horizons: list[str], part: list[str] = PART) -> DataFrame:
    """Mean returns by type, measured from the confirming row."""
    at = df.select(*part, F.col("bar_idx").alias("confirm_idx"), *horizons)
    return events.join(at, [*part, "confirm_idx"]).groupBy(*part, "div_type").agg(F.count(F.lit(1)).alias("n"), *[F.avg(h).alias(f"mean_{h}") for h in horizons])


def compressions(df: DataFrame, quantile: float = 0.10, ahead: int = 10, threshold: float = 1.5, part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """Expansions after a narrow gap: the first extreme rate within `ahead` rows of a row in the series' narrowest gaps.

    Compressions that lead to one expansion count once, by the earliest. Columns:
    bar_close, direction (the rate's sign) and lag_bars.
    """
    rows = df if "bar_idx" in df.columns else with_bar_idx(df, part, order)
    edge = F.expr(f"percentile(abs(B_gap_norm), {quantile})").over(Window.partitionBy(*part))
    at = first_within(F.abs("B_zroc") > threshold, ahead, by(part, order))
    narrow = rows.withColumn("_j", at).withColumn("_edge", edge).where((F.abs("B_gap_norm") <= F.col("_edge")) & F.col("_j").isNotNull())
    firsts = narrow.groupBy(*part, "_j").agg(F.min("bar_idx").alias("_i"))
    there = rows.select(*part, F.col("bar_idx").alias("_j"), order, F.signum("B_zroc").cast("int").alias("direction"))
    return firsts.join(there, [*part, "_j"]).select(*part, order, "direction", (F.col("_j") - F.col("_i")).cast("int").alias("lag_bars"))


def squeeze_returns(events: DataFrame, df: DataFrame, horizons: list[str], part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """By horizon: events, mean return in the event's direction, mean size, and the mean size of all rows."""
    long = lambda t, extra: t.unpivot([F.col(c) for c in extra], [F.col(h) for h in horizons], "horizon", "ret")
    hit = long(events.join(df.select(*part, order, *horizons), [*part, order]), [*part, "direction"])
    made = hit.groupBy(*part, "horizon").agg(F.count("ret").alias("n"), F.avg(F.col("direction") * F.col("ret")).alias("mean_directional"), F.avg(F.abs("ret")).alias("mean_abs"))
    base = long(df, part).groupBy(*part, "horizon").agg(F.avg(F.abs("ret")).alias("mean_abs_all"))
    return made.join(base, [*part, "horizon"])


