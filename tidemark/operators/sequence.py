"""Building blocks over ordered rows of a series."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.schema import ORDER, PART


def by(part: list[str] = PART, order: str = ORDER) -> WindowSpec:
    return Window.partitionBy(*part).orderBy(order)


def with_bar_idx(df: DataFrame, part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """Adds bar_idx, the row's place in its series from 0."""
    return df.withColumn("bar_idx", F.row_number().over(by(part, order)) - 1)


def ema(df: DataFrame, specs: dict[str, tuple[str, int]], part: list[str] = PART, order: str = ORDER, block: int = 64) -> DataFrame:
    """Adds recursive exponential averages: {new column: (column, span)}; columns must not be null.

    A series is cut into blocks of `block` rows. Each block is folded on its own from
    zero; what the blocks before hand on is a second fold, over as many block ends as
    still weigh anything; a row's value is the sum of both. The work is linear in the
    rows, and no task holds more than a block.
    """
    rows = with_bar_idx(df, part, order)
    carried = [c for c in rows.columns if c not in part and c != "bar_idx"]
    blocks = rows.groupBy(*part, F.floor(F.col("bar_idx") / block).alias("_block")).agg(F.array_sort(F.collect_list(F.struct("bar_idx", *carried))).alias("_rows"))
    for name, (col, span) in specs.items():
        blocks = _running(blocks, name, col, 2.0 / (span + 1), block, part)
    made = blocks.select(*part, F.explode(F.arrays_zip("_rows", *[f"_v_{n}" for n in specs])).alias("_z"))
    return made.select(*part, *[F.col(f"_z._rows.{c}").alias(c) for c in ["bar_idx", *carried]], *[F.col(f"_z._v_{n}").alias(n) for n in specs])


def _running(blocks: DataFrame, name: str, col: str, a: float, block: int, part: list[str]) -> DataFrame:
    """Adds _v_name, the averages of a block's rows."""
    keep = 1 - a
    x = F.transform("_rows", lambda r: r[col])
    seed = F.when(F.col("_block") == 0, x[0]).otherwise(x[0] * a)
    alone = F.aggregate(F.slice(x, 2, F.size(x)), F.array(seed), lambda acc, v: F.array_append(acc, F.element_at(acc, -1) * keep + v * a))
    far = ceil(18 * log(10) / -log(keep) / block) + 1
    ends = F.collect_list(F.struct(F.element_at(f"_r_{name}", -1).alias("v"), F.size("_rows").alias("n"))).over(by(part, "_block").rowsBetween(-far, -1))
    carry = F.aggregate(f"_e_{name}", F.lit(0.0), lambda acc, e: acc * F.pow(F.lit(keep), e["n"].cast("double")) + e["v"])
    whole = F.transform(f"_r_{name}", lambda v, i: v + F.col(f"_c_{name}") * F.pow(F.lit(keep), (i + 1).cast("double")))
    return blocks.withColumn(f"_r_{name}", alone).withColumn(f"_e_{name}", ends).withColumn(f"_c_{name}", carry).withColumn(f"_v_{name}", whole)


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def zero_cross(x: Column, window: WindowSpec) -> Column:
    """1 where x passes from below zero to above it, -1 the other way; touching zero is no cross."""
    before = F.lag(x).over(window)
    return F.when((before < 0) & (x > 0), 1).when((before > 0) & (x < 0), -1).otherwise(0)


def quadrant_state(level: Column, slope: Column, window: WindowSpec) -> Column:
    """Side and pace as one of four states; a level of zero leans against its slope, and gaps keep the last state."""
    state = (
        F.when((level > 0) & (slope > 0), "bull_accel")
        .when((level > 0) & (slope <= 0), "bull_decel")
        .when((level < 0) & (slope >= 0), "bear_decel")
        .when((level < 0) & (slope < 0), "bear_accel")
        .when((level == 0) & (slope > 0), "bear_decel")
        .when((level == 0) & (slope < 0), "bull_decel")
    )
    return F.last(state, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))


def streak(df: DataFrame, cond: Column, part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """Adds streak: how many rows up to this one hold the condition without a break."""
    marked = df.withColumn("_ok", F.coalesce(cond, F.lit(False)))
    running = by(part, order).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("_island", F.sum(F.when(F.col("_ok"), 0).otherwise(1)).over(running))
    inside = by([*part, "_island"], order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("streak", F.sum(F.when(F.col("_ok"), 1).otherwise(0)).over(inside)).drop("_ok", "_island")


def first_within(cond: Column, bars: int, window: WindowSpec) -> Column:
    """bar_idx of the first of the next `bars` rows that holds the condition."""
    return F.min(F.when(cond, F.col("bar_idx"))).over(window.rowsBetween(1, bars))
