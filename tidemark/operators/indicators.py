"""The two indicator families, the warm-up cut and forward-looking labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sequence import by, ema, quadrant_state, sign, with_bar_idx, zero_cross
from tidemark.schema import HORIZONS, ORDER, PART, TIMEFRAMES, WARMUP, Spans


def indicator_a(bars: DataFrame, spans: Spans = Spans(), part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """Convergence of two averages of the close: line, signal, histogram, signs, crosses and state."""
    w = by(part, order)
    fast = ema(bars, {"_fast": ("close", spans.fast), "_slow": ("close", spans.slow)}, part, order)
    line = fast.withColumn("A_macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow", "bar_idx")
    out = ema(line, {"A_signal": ("A_macd", spans.signal)}, part, order).withColumn("A_hist", F.col("A_macd") - F.col("A_signal"))
    out = out.withColumn("A_hist_slope", F.col("A_hist") - F.lag("A_hist").over(w))
    return out.withColumns(
        {
            "A_macd_sign": sign(F.col("A_macd")),
            "A_hist_sign": sign(F.col("A_hist")),
            "A_macd_zero_cross": zero_cross(F.col("A_macd"), w),
            "A_hist_zero_cross": zero_cross(F.col("A_hist"), w),
            "A_state": quadrant_state(F.col("A_hist"), F.col("A_hist_slope"), w),
        }
    )


def indicator_b(bars: DataFrame, spans: Spans = Spans(), part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """Gap of two slow averages, its rate of change, the rate's z-score, flags and state.

    B_roc_invalid marks rates whose base is within the smallest hundredth of the
    series; the flag excludes nothing by itself.
    """
    w = by(part, order)
    out = ema(bars, {"_fast": ("close", spans.gap_fast), "_slow": ("close", spans.gap_slow)}, part, order)
    out = out.withColumn("B_gap", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    out = out.withColumn("_prev", F.lag("B_gap", spans.roc).over(w))
    out = out.withColumn("B_gap_norm", F.try_divide("B_gap", "close"))
    out = out.withColumn("B_roc", F.when(F.col("_prev") == 0, 0.0).otherwise(F.try_divide(100.0 * (F.col("B_gap") - F.col("_prev")), "_prev")))
    out = out.withColumn("_edge", F.expr("percentile(abs(_prev), 0.01)").over(Window.partitionBy(*part)))
    out = out.withColumn("B_roc_invalid", F.coalesce(F.abs("_prev") < F.col("_edge"), F.lit(False)).cast("int"))
    last = w.rowsBetween(-(spans.z - 1), 0)
    full = F.count("B_roc").over(last) == spans.z
    spread = F.nullif(F.stddev_samp("B_roc").over(last), F.lit(0.0))
    out = out.withColumn("B_zroc", F.when(full, F.try_divide(F.col("B_roc") - F.avg("B_roc").over(last), spread)))
    out = out.withColumn("B_gap_acc", F.col("B_gap") - F.col("_prev")).withColumn("B_roc_slope", F.col("B_roc") - F.lag("B_roc").over(w))
    out = out.withColumn("B_zroc_extreme", F.coalesce(F.abs("B_zroc") > 2, F.lit(False)).cast("int"))
    return out.withColumn("B_state", quadrant_state(F.col("B_roc"), F.col("B_roc_slope"), w)).drop("_prev", "_edge")


def features(bars: DataFrame, spans: Spans = Spans(), part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """Both families on one table."""
    return indicator_b(indicator_a(bars, spans, part, order).drop("bar_idx"), spans, part, order)


def drop_warmup(df: DataFrame, bars: int = WARMUP, part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """Without each series' first rows; bar_idx counts again from 0."""
    return with_bar_idx(with_bar_idx(df, part, order).where(F.col("bar_idx") >= bars).drop("bar_idx"), part, order)


def forward_returns(df: DataFrame, horizons=HORIZONS, part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """Adds ret_fwd_N: the return of the next N rows; null where the series ends before."""
    w = by(part, order)
    return df.withColumns({f"ret_fwd_{n}": F.try_divide(F.lead("close", n).over(w), F.col("close")) - 1.0 for n in horizons})


def triple_barrier(df: DataFrame, tf: str = "5m", part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """Adds barrier_hit: 1 or -1 for the barrier that closes touch first, 0 for none, null without a full window."""
    if tf not in TIMEFRAMES:
        raise ValueError(f"unknown bar size {tf!r}: one of {list(TIMEFRAMES)}")
    rate, bars = TIMEFRAMES[tf].barrier, TIMEFRAMES[tf].barrier_bars
    ahead = df.withColumn("_next", F.collect_list("close").over(by(part, order).rowsBetween(1, bars)))
    up = F.array_position(F.transform("_next", lambda c: c >= F.col("close") * (1.0 + rate)), True)
    down = F.array_position(F.transform("_next", lambda c: c <= F.col("close") * (1.0 - rate)), True)
    hit = F.when((up > 0) & ((down == 0) | (up <= down)), 1).when(down > 0, -1).otherwise(0)
    return ahead.withColumn("barrier_hit", F.when(F.size("_next") == bars, hit)).drop("_next")


def regime(df: DataFrame, bars: int = 20, part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """Adds regime: the direction of a line through the last closes if it explains over half their variance, else chop."""
    rows = df if "bar_idx" in df.columns else with_bar_idx(df, part, order)
    last = by(part, order).rowsBetween(-(bars - 1), 0)
    x = F.col("bar_idx").cast("double")
    slope, r2 = F.regr_slope(F.col("close"), x).over(last), F.regr_r2(F.col("close"), x).over(last)
    flat = F.var_pop("close").over(last) == 0
    label = F.when(flat, "chop").when((r2 > 0.5) & (slope > 0), "trend_up").when((r2 > 0.5) & (slope < 0), "trend_down").otherwise("chop")
    return rows.withColumn("regime", F.when(F.count("close").over(last) == bars, label))


