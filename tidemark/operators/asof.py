"""Joins in time that never look ahead."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sequence import with_bar_idx
from tidemark.schema import HIGHER, ORDER, PART
from tidemark.sources.bars import keep_first


def asof_backward(left: DataFrame, rights: dict[str, DataFrame], part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """Every left row with the last row of each right table at its time or before.

    Right columns besides the keys get the table's name as a suffix, and so does the
    right time. All tables are laid into one order with right rows before left ones
    of the same time, so one sort serves any number of right tables.
    """
    names = list(rights)
    kept = {n: [c for c in rights[n].columns if c not in part] for n in names}
    kinds = {n: rights[n].select(*kept[n]).schema.simpleString() for n in names}
    base = [c for c in left.columns if c not in part]

    def laid(df: DataFrame, name: str | None) -> DataFrame:
        cols = [F.struct(*kept[n]).alias(f"_{n}") if n == name else F.lit(None).cast(kinds[n]).alias(f"_{n}") for n in names]
        mine = F.struct(*base) if name is None else F.lit(None).cast(left.select(*base).schema.simpleString())
        return df.select(*part, F.col(order).alias("_at"), F.lit(1 if name is None else 0).alias("_side"), mine.alias("_left"), *cols)

    one = reduce(DataFrame.unionByName, [laid(left, None), *[laid(rights[n], n) for n in names]])
    w = Window.partitionBy(*part).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    one = one.withColumns({f"_{n}": F.last(f"_{n}", ignorenulls=True).over(w) for n in names}).where("_side = 1")
    return one.select(*part, "_left.*", *[F.col(f"_{n}.{c}").alias(f"{c}_{n}") for n in names for c in kept[n]])


def master(frames: dict[str, DataFrame], part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """The 5m features with the indicators of each higher bar size as of every row."""
    rights = {tf: frames[tf].select(*part, order, *[c for c in frames[tf].columns if c.startswith(("A_", "B_"))]) for tf in frames if tf != "5m"}
    return asof_backward(frames["5m"], rights, part, order)


def lookahead_violations(df: DataFrame, tfs=HIGHER, order: str = ORDER) -> DataFrame:
    """One row: for each bar size how many rows hold a higher bar that closes after them."""
    return df.agg(*[F.count_if(F.col(f"{order}_{tf}") > F.col(order)).alias(f"n_{tf}") for tf in tfs])


def extract_tf(df: DataFrame, tf: str, part: list[str] = PART, order: str = ORDER, drop_null_key: bool = False) -> DataFrame:
    """A bar size's table as seen from the master: one row for each of its bars, with the 5m close at first sight.

    Rows before the first bar share a null key and stay as one row unless dropped.
    """
    if tf == "5m":
        return df.select(*part, order, "close", *[c for c in df.columns if c.startswith(("A_", "B_")) and not c.endswith(tuple(f"_{t}" for t in HIGHER))])
    mine = [c for c in df.columns if c.startswith(("A_", "B_")) and c.endswith(f"_{tf}")]
    picked = df.select(*part, F.col(f"{order}_{tf}").alias("_key"), F.col(order).alias("_at"), "close", *[F.col(c).alias(c.removesuffix(f"_{tf}")) for c in mine])
    if drop_null_key:
        picked = picked.where("_key is not null")
    return keep_first(picked, [*part, "_key"], [F.col("_at")]).drop("_at").withColumnRenamed("_key", order)


def followthrough(lower: DataFrame, higher: DataFrame, lower_col: str, higher_col: str, bars: int, part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """For each cross on the lower bars whether one of the next `bars` higher bars, all strictly later, crosses alike.

    Columns: keys, direction, followed_through, lag_bars (the first such bar's number).
    """
    up = with_bar_idx(higher.select(*part, order, F.col(higher_col).alias("_hz")), part, order).withColumnRenamed("bar_idx", "_h")
    flips = lower.where(F.col(lower_col) != 0).select(*part, order, F.col(lower_col).alias("direction"))
    seen = asof_backward(flips, {"x": up.select(*part, order, "_h")}, part, order)
    near = seen.withColumn("_h", F.explode(F.sequence(F.coalesce("_h_x", F.lit(-1)) + 1, F.coalesce("_h_x", F.lit(-1)) + bars)))
    joined = near.join(up.select(*part, "_h", "_hz"), [*part, "_h"], "left")
    lag = F.min(F.when(F.col("_hz") == F.col("direction"), F.col("_h") - F.coalesce("_h_x", F.lit(-1))))
    out = joined.groupBy(*part, order, "direction").agg(lag.cast("double").alias("lag_bars"))
    return out.withColumn("followed_through", F.col("lag_bars").isNotNull())


