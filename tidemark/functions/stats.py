"""Statistics of ordered returns, as aggregates and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.tails import chi2_p, normal_p, student_p
from tidemark.operators.sequence import by
from tidemark.schema import ORDER, PART, STATES


def unpivot(df: DataFrame, keep: list[str], cols: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot([F.col(c) for c in keep], [F.col(c) for c in cols], name, value)


def hac_mean(df: DataFrame, keys: list[str], value: str = "ret", lags: int = 12, order: str = ORDER, least_mean: int = 0, least_t: int = 20) -> DataFrame:
    """Mean, hit rate, and autocorrelation-robust t of the mean with its normal p-value, by key, one row for every key that occurs.

    n_rows counts all rows and n those with a value; lags run over rows with a value
    only. The variance is Bartlett-weighted with the factor n / (n - 1). Below
    least_mean values mean and hit rate are null, below least_t the t; a variance of
    zero has no t either.
    """
    rows = df.select(*keys, order, F.col(value).alias("_x"))
    full = rows.where("_x is not null")
    part = Window.partitionBy(*keys)
    full = full.withColumn("_e", F.col("_x") - F.avg("_x").over(part))
    seq = part.orderBy(order)
    full = full.withColumns({f"_l{k}": F.col("_e") * F.lag("_e", k).over(seq) for k in range(1, lags + 1)})
    cross = reduce(lambda a, b: a + b, [F.coalesce(F.sum(f"_l{k}"), F.lit(0.0)) * (2 * (1 - k / (lags + 1))) for k in range(1, lags + 1)], F.lit(0.0))
    made = full.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mean_ret"), F.avg((F.col("_x") > 0).cast("double")).alias("hit_rate"), (F.sum(F.col("_e") * F.col("_e")) + cross).alias("_s")
    )
    all_keys = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    same = reduce(lambda a, b: a & b, [all_keys[k].eqNullSafe(made[k]) for k in keys])
    out = all_keys.join(made, same, "left").select(*[all_keys[k] for k in keys], "n_rows", F.coalesce("n", F.lit(0)).alias("n"), "mean_ret", "hit_rate", "_s")
    shown = F.col("n") >= least_mean
    t = F.try_divide("mean_ret", F.sqrt(F.try_divide("_s", F.col("n") * (F.col("n") - 1))))
    return out.select(
        *keys, "n_rows", "n", F.when(shown, F.col("mean_ret")).alias("mean_ret"), F.when(shown, F.col("hit_rate")).alias("hit_rate"), F.when((F.col("n") >= least_t) & (F.col("_s") > 0), t).alias("t_stat")
    ).withColumn("p_value", normal_p("t_stat"))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows with both values; null where one side does not vary."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_samp(a, b), F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0)))


def correlations(df: DataFrame, xs: list[str], ys: list[str], part: list[str] = PART) -> DataFrame:
    """(part, feature, horizon, corr) of every pair of columns, in one pass."""
    sums = df.groupBy(*part).agg(*[pearson(F.col(x), F.col(y)).alias(f"{x}|{y}") for x in xs for y in ys])
    long = unpivot(sums, part, [f"`{x}|{y}`" for x in xs for y in ys], "_pair", "corr")
    pair = F.split(F.translate("_pair", "`", ""), r"\|")
    return long.select(*part, pair[0].alias("feature"), pair[1].alias("horizon"), "corr")


def mid_rank(df: DataFrame, col: str, keys: list[str], name: str) -> DataFrame:
    """Adds a column's rank from 1; equal values share the mean of theirs."""
    order = Window.partitionBy(*keys).orderBy(col)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, col))
    return df.withColumn(name, F.rank().over(order) + (ties - 1) / 2)


def rank_correlations(df: DataFrame, xs: list[str], ys: list[str], part: list[str] = PART) -> DataFrame:
    """Spearman's correlation: ranks are taken over the rows that have both values of a pair."""
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("feature"), F.lit(y).alias("horizon"), F.col(x).alias("x"), F.col(y).alias("y")) for x in xs for y in ys]))
    long = df.select(*part, pairs.alias("_p")).select(*part, "_p.*").where("x is not null and y is not null")
    keys = [*part, "feature", "horizon"]
    ranked = mid_rank(mid_rank(long, "x", keys, "rx"), "y", keys, "ry")
    return ranked.groupBy(*keys).agg(pearson(F.col("rx"), F.col("ry")).alias("corr"))


def cross_correlation(df: DataFrame, a: str, b: str, most: int = 20, part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """(part, lag, corr) of a with b shifted by lag rows, for all lags in one pass; a that leads by 3 peaks at -3."""
    w = by(part, order)
    lags = range(-most, most + 1)
    shifted = df.select(*part, order, a, *[F.lag(b, k).over(w).alias(f"_k{k + most}") for k in lags])
    sums = shifted.groupBy(*part).agg(*[pearson(F.col(a), F.col(f"_k{k + most}")).alias(f"_k{k + most}") for k in lags])
    long = unpivot(sums, part, [f"_k{k + most}" for k in lags], "_lag", "corr")
    return long.select(*part, (F.substring("_lag", 3, 9).cast("int") - most).alias("lag"), "corr")


def peak_lag(curve: DataFrame, part: list[str] = PART) -> DataFrame:
    """The lag of the largest absolute correlation; the smaller of equals."""
    return curve.where("corr is not null").groupBy(*part).agg(F.max_by("lag", F.struct(F.abs("corr"), -F.col("lag"))).alias("peak_lag"))


def deciles(df: DataFrame, feature: str, horizons: list[str], part: list[str] = PART) -> DataFrame:
    """Means of returns by decile of a feature: right-closed bins between its distinct quantiles, the first with both ends.

    Features with fewer than three distinct quantiles give no rows.
    """
    edges = F.expr(f"percentile({feature}, array(0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1))").over(Window.partitionBy(*part))
    rows = df.where(F.col(feature).isNotNull()).withColumn("_e", edges).withColumn("_e", F.array_distinct("_e")).where(F.size("_e") >= 3)
    decile = F.greatest(F.lit(1), F.size(F.filter("_e", lambda k: k < F.col(feature))))
    rows = rows.withColumn("decile", decile).withColumn("lo", F.element_at("_e", F.col("decile"))).withColumn("hi", F.element_at("_e", F.col("decile") + 1))
    return rows.groupBy(*part, "decile", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), *[F.avg(h).alias(f"mean_{h}") for h in horizons])


def nested_ols(df: DataFrame, y: str, a: str, b: str, lags: int = 12, part: list[str] = PART, order: str = ORDER, least: int = 30) -> DataFrame:
    """What b adds to a in explaining y: R2 of both regressions, their difference, b's coefficient, robust t and normal p-value.

    Closed-form normal equations on centred values, then one pass over residual
    scores and their lags for the sandwich, with the factor n / (n - 3).
    """
    full = df.select(*part, order, F.col(y).alias("y"), F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    all_ = Window.partitionBy(*part)
    c = full.withColumns({k: F.col(k) - F.avg(k).over(all_) for k in ("y", "a", "b")})
    moments = {f"s_{p}{q}": F.sum(F.col(p) * F.col(q)) for p, q in ("aa", "ab", "bb", "ay", "by", "yy")}
    m = c.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in moments.items()])
    det = F.nullif(F.col("s_aa") * F.col("s_bb") - F.col("s_ab") * F.col("s_ab"), F.lit(0.0))
    m = m.withColumn("_det", det).withColumns(
        {"_ba": (F.col("s_bb") * F.col("s_ay") - F.col("s_ab") * F.col("s_by")) / F.col("_det"), "coef_b": (F.col("s_aa") * F.col("s_by") - F.col("s_ab") * F.col("s_ay")) / F.col("_det")}
    )
    e = c.join(m, part).withColumn("_u", F.col("y") - F.col("_ba") * F.col("a") - F.col("coef_b") * F.col("b"))
    # The influence of a row on b's coefficient, so that the sandwich is a sum of scalars.
    e = e.withColumn("_q", F.col("_u") * (F.col("s_aa") * F.col("b") - F.col("s_ab") * F.col("a")) / F.col("_det"))
    w = by(part, order)
    e = e.withColumns({f"_l{k}": F.col("_q") * F.lag("_q", k).over(w) for k in range(1, lags + 1)})
    cross = reduce(lambda p, q: p + q, [F.coalesce(F.sum(f"_l{k}"), F.lit(0.0)) * (2 * (1 - k / (lags + 1))) for k in range(1, lags + 1)], F.lit(0.0))
    keep = ["n", "coef_b", "s_ay", "s_aa", "s_yy"]
    out = e.groupBy(*part, *keep).agg(F.sum(F.col("_u") * F.col("_u")).alias("_ssr"), (F.sum(F.col("_q") * F.col("_q")) + cross).alias("_v"))
    enough = F.col("n") >= least
    r0 = F.try_divide(F.col("s_ay") * F.col("s_ay"), F.col("s_aa") * F.col("s_yy"))
    r1 = 1 - F.try_divide("_ssr", "s_yy")
    t = F.try_divide("coef_b", F.sqrt(F.col("_v") * F.col("n") / (F.col("n") - 3)))
    return out.select(*part, *[F.when(enough, v).alias(k) for k, v in {"n_obs": F.col("n"), "r2_a": r0, "r2_ab": r1, "delta_r2": r1 - r0, "coef_b": F.col("coef_b"), "t_b": t}.items()]).withColumn("p_b", normal_p("t_b"))


def joint_states(df: DataFrame, a: str, b: str, ret: str, lags: int = 12, part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """All sixteen cells of two states with row counts, mean, hit rate, t and p-value; below five rows the statistics are null."""
    spark = df.sparkSession
    rows = df.where(F.col(a).isin(*STATES) & F.col(b).isin(*STATES)).select(*part, order, F.col(a).alias("state_a"), F.col(b).alias("state_b"), F.col(ret).alias("ret"))
    cells = hac_mean(rows, [*part, "state_a", "state_b"], "ret", lags, order)
    grid = spark.createDataFrame([(x, y) for x in STATES for y in STATES], "state_a string, state_b string")
    # Sixteen rows for each series.
    dense = df.select(*part).distinct().join(F.broadcast(grid))
    out = dense.join(cells, [*part, "state_a", "state_b"], "left")
    n = F.coalesce("n_rows", F.lit(0))
    return out.select(*part, "state_a", "state_b", n.alias("n"), *[F.when(n >= 5, F.col(c)).alias(c) for c in ("mean_ret", "hit_rate", "t_stat", "p_value")])


def chi_square(cells: DataFrame, part: list[str] = PART) -> DataFrame:
    """Independence of the two states: chi2, degrees of freedom, p-value, cells with p below 0.05, and mean returns on and off the diagonal."""
    row, col, all_ = Window.partitionBy(*part, "state_a"), Window.partitionBy(*part, "state_b"), Window.partitionBy(*part)
    expected = F.try_divide(F.sum("n").over(row).cast("double") * F.sum("n").over(col), F.sum("n").over(all_))
    rows = cells.withColumn("_x", expected)
    same = F.col("state_a") == F.col("state_b")
    return rows.groupBy(*part).agg(
        F.sum(F.try_divide((F.col("n") - F.col("_x")) * (F.col("n") - F.col("_x")), "_x")).alias("chi2"),
        F.lit((len(STATES) - 1) ** 2).alias("dof"),
        F.avg(F.when(same, F.col("mean_ret"))).alias("diag_mean"),
        F.avg(F.when(~same, F.col("mean_ret"))).alias("off_diag_mean"),
        F.count_if(F.col("p_value") < 0.05).alias("n_significant"),
    ).withColumn("p_chi2", chi2_p("chi2", F.col("dof").cast("double")))


def fdr_bh(df: DataFrame, p: str, keys: list[str], tie: list[str]) -> DataFrame:
    """Adds p_adj by Benjamini and Hochberg within each family; nulls stay null and do not count."""
    known = df.where(F.col(p).isNotNull())
    # Largest first: a frame that ends at the current row grows by one row, one that starts there is read anew for each.
    order = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in (p, *tie)])
    m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ranked = known.withColumn("_raw", F.col(p) * m / (m - F.row_number().over(order) + 1))
    adjusted = ranked.withColumn("p_adj", F.least(F.lit(1.0), F.min("_raw").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_raw")
    return adjusted.unionByName(df.where(F.col(p).isNull()).withColumn("p_adj", F.lit(None).cast("double")))


def bonferroni(p: Column, m: int) -> Column:
    return F.when(p.isNotNull(), F.least(F.lit(1.0), p * m))


def roc_auc(df: DataFrame, label: str, score: str, keys: list[str] = PART) -> DataFrame:
    """Exact area under the curve from mean ranks; null with one class only."""
    ranked = mid_rank(df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(*keys, label, score), score, keys, "_r")
    pos = F.col(label) == 1
    sums = ranked.groupBy(*keys).agg(F.sum(F.when(pos, F.col("_r"))).alias("s"), F.count_if(pos).cast("double").alias("p"), F.count_if(~pos).cast("double").alias("q"))
    return sums.select(*keys, F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"), F.col("p").cast("long").alias("n_pos"), F.col("q").cast("long").alias("n_neg"))


def mean_difference(df: DataFrame, side: str, cols: list[str], keys: list[str] = PART) -> DataFrame:
    """For each feature the pooled effect size and Welch's t with its p-value between rows with side true and false."""
    frame = df.where(F.col(side).isNotNull())
    sizes = frame.groupBy(*keys).agg(F.count_if(side).alias("n_worked"), F.count_if(~F.col(side)).alias("n_failed"))
    long = unpivot(frame.select(*keys, side, *[F.col(c).cast("double").alias(c) for c in cols]), [*keys, side], cols, "feature", "x").where("x is not null")
    on, off = F.when(F.col(side), F.col("x")), F.when(~F.col(side), F.col("x"))
    m = long.groupBy(*keys, "feature").agg(F.count(on).alias("a"), F.count(off).alias("b"), F.avg(on).alias("mean_worked"), F.avg(off).alias("mean_failed"), F.var_samp(on).alias("va"), F.var_samp(off).alias("vb"))
    diff = F.col("mean_worked") - F.col("mean_failed")
    pooled = F.sqrt(F.try_divide((F.col("a") - 1) * F.col("va") + (F.col("b") - 1) * F.col("vb"), F.col("a") + F.col("b") - 2))
    welch = F.sqrt(F.try_divide("va", "a") + F.try_divide("vb", "b"))
    va, vb = F.try_divide("va", "a"), F.try_divide("vb", "b")
    dof = F.try_divide((va + vb) * (va + vb), F.try_divide(va * va, F.col("a") - 1) + F.try_divide(vb * vb, F.col("b") - 1))
    return m.withColumn("_dof", dof).join(sizes, keys).select(*keys, "feature", "n_worked", "n_failed", "mean_worked", "mean_failed", F.try_divide(diff, pooled).alias("cohens_d"), F.try_divide(diff, welch).alias("t_stat"), student_p(F.try_divide(diff, welch), F.col("_dof")).alias("p_value"))
