"""Names, types and default parameters that the operators share."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T


class Timeframe(NamedTuple):
    minutes: int
    barrier: float
    barrier_bars: int
    hac_lags: int


#: Bar sizes with their barrier thresholds, barrier windows and autocorrelation lags (fixed values).
TIMEFRAMES = {
    "5m": Timeframe(5, 0.0020, 24, 12),
    "15m": Timeframe(15, 0.0035, 24, 8),
    "1h": Timeframe(60, 0.0060, 24, 6),
    "1d": Timeframe(1440, 0.0120, 10, 4),
}
HIGHER = ("15m", "1h", "1d")
HORIZONS = (1, 3, 6, 12, 24)
STATES = ("bull_accel", "bull_decel", "bear_decel", "bear_accel")
#: Session bounds in seconds of the day, both included: 09:15:00 and 15:29:00.
SESSION = (33300, 55740)
#: Bars that indicators need before their values count.
WARMUP = 270
#: Flags of a rule, lowest bit first: the sign of an indicator on a bar size.
FLAGS = ("A_5m", "B_5m", "A_15m", "B_15m", "A_1h", "B_1h", "A_1d", "B_1d")

#: A table holds several series; every window is by series and in order of bar_close.
PART, ORDER = ["series_id"], "bar_close"


class Spans(NamedTuple):
    fast: int = 12
    slow: int = 26
    signal: int = 9
    gap_fast: int = 40
    gap_slow: int = 90
    roc: int = 7
    z: int = 100


RAW = T.StructType([T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")] + [T.StructField("timestamp", T.StringType())])


def name_for(base: str, tf: str) -> str:
    """Column of a bar size in a master table; 5m has no suffix."""
    return base if tf == "5m" else f"{base}_{tf}"


def flag_column(flag: str) -> str:
    """The indicator column whose sign a rule's flag is."""
    ind, tf = flag.split("_")
    return name_for("A_hist" if ind == "A" else "B_roc", tf)
