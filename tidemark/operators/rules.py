"""Boolean rules over the signs of eight indicators: evaluation, ranking, filters and validation.

A row holds for exactly one of the 256 rules, so one grouping by its rule evaluates
all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import bonferroni, hac_mean
from tidemark.operators.mtf import truth
from tidemark.schema import FLAGS, ORDER, PART, flag_column

RULES = 1 << len(FLAGS)


def enumerate_rules(spark: SparkSession) -> DataFrame:
    """All rules with their flags."""
    bits = [F.shiftright(F.col("rule_id"), i).bitwiseAND(1).cast("int").alias(f) for i, f in enumerate(FLAGS)]
    return spark.range(RULES).select(F.col("id").cast("int").alias("rule_id")).select("rule_id", *bits)


def rule_id() -> Column:
    """The rule that a master row holds for; missing indicators are not positive."""
    return reduce(lambda a, b: a + b, [truth(F.col(flag_column(f)) > 0).cast("int") * (1 << i) for i, f in enumerate(FLAGS)])


def active_flags() -> Column:
    """The names of a rule's flags that are set, comma-joined."""
    return F.concat_ws(", ", *[F.when(F.shiftright(F.col("rule_id"), i).bitwiseAND(1) == 1, f) for i, f in enumerate(FLAGS)])


def evaluate(df: DataFrame, ret: str = "ret_fwd_12", lags: int = 12, keys: list[str] | None = None, part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """Every rule, also those that no row holds for: n, frequency, mean, hit rate, t, p-value and that times the rules.

    keys: further columns to evaluate by. frequency is n over the rows of the group.
    """
    by = [*part, *(keys or [])]
    rows = df.withColumn("rule_id", rule_id())
    stats = hac_mean(rows, [*by, "rule_id"], ret, lags, order, least_mean=5)
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    # 256 rows for each group.
    dense = totals.join(F.broadcast(enumerate_rules(df.sparkSession).select("rule_id"))).join(stats, [*by, "rule_id"], "left")
    n = F.coalesce("n", F.lit(0))
    return dense.select(*by, "rule_id", n.alias("n"), (n / F.col("_all")).alias("frequency"), "mean_ret", "hit_rate", "t_stat", "p_value", bonferroni(F.col("p_value"), RULES).alias("p_bonf"))


def rank(rules: DataFrame, top: int = 20, part: list[str] = PART) -> DataFrame:
    """The best and worst rules of each series by frequency * |mean| * (hit rate - 0.5); equal ones by rule_id."""
    scored = rules.withColumn("composite", F.col("frequency") * F.abs("mean_ret") * (F.col("hit_rate") - 0.5)).where("composite is not null")
    best, worst = Window.partitionBy(*part).orderBy(F.desc("composite"), "rule_id"), Window.partitionBy(*part).orderBy("composite", "rule_id")
    ranked = scored.withColumns({"_b": F.row_number().over(best), "_w": F.row_number().over(worst)})
    sides = F.explode(F.array(F.struct(F.lit("top").alias("side"), F.col("_b").alias("place")), F.struct(F.lit("bottom").alias("side"), F.col("_w").alias("place"))))
    return ranked.select(*part, "rule_id", "n", "mean_ret", "hit_rate", "composite", sides.alias("_s")).select("*", "_s.*").drop("_s").where(F.col("place") <= top)


def dedupe(ranked: DataFrame, least: int = 2, part: list[str] = PART) -> DataFrame:
    """In order of place, rules that differ in `least` flags or more from all kept so far; at most 256 a series."""
    listed = ranked.groupBy(*part).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "rule_id"))), lambda s: s["rule_id"]).alias("_ids"))
    kept = F.aggregate("_ids", F.array().cast("array<int>"), lambda acc, x: F.when(F.forall(acc, lambda k: F.bit_count(k.bitwiseXOR(x)) >= least), F.array_append(acc, x)).otherwise(acc))
    return listed.select(*part, F.posexplode(kept).alias("place", "rule_id"))


def carry(evaluated: DataFrame, rules: list[int]) -> DataFrame:
    """The rows of the listed rules, with each rule's place in the list."""
    listed = evaluated.sparkSession.createDataFrame([(k, x) for k, x in enumerate(rules)], "place int, rule_id int")
    return evaluated.join(F.broadcast(listed), "rule_id")  # as many rows as the caller listed


def with_outcome(df: DataFrame, ret: str, expected: int = 1) -> DataFrame:
    """Adds worked: the return has the expected sign; a return of zero has not, a missing one is null."""
    return df.withColumn("worked", F.when(F.col(ret).isNotNull(), F.signum(ret) == expected))


def worked_failed(df: DataFrame, rule: int, ret: str = "ret_fwd_12", expected: int = 1, part: list[str] = PART) -> DataFrame:
    """Counts of a rule's rows by outcome, its hit rate, and that of all rows."""
    rows = with_outcome(df.withColumn("rule_id", rule_id()), ret, expected)
    mine = F.col("rule_id") == rule
    return rows.groupBy(*part).agg(
        F.count_if(mine & F.col("worked")).alias("n_worked"), F.count_if(mine & ~F.col("worked")).alias("n_failed"), F.avg(F.when(mine, F.col("worked").cast("double"))).alias("hit_rule"), F.avg(F.col("worked").cast("double")).alias("hit_all")
    )


def propose_filters(differences: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Features whose effect exceeds the threshold, with the midpoint of the means and the side that worked."""
    strong = differences.where(F.abs("cohens_d") > threshold)
    side = F.when(F.col("cohens_d") > 0, "above").otherwise("below")
    return strong.withColumn("midpoint", (F.col("mean_worked") + F.col("mean_failed")) / 2).withColumn("direction", side)


def before_after(df: DataFrame, mask: Column, keep: Column, ret: str = "ret_fwd_12", lags: int = 12, part: list[str] = PART, order: str = ORDER) -> DataFrame:
    """Statistics of the masked rows, and of those that a filter keeps; frequency is the share of masked rows."""
    rows = df.where(truth(mask)).withColumn("stage", F.explode(F.when(truth(keep), F.array(F.lit("before"), F.lit("after"))).otherwise(F.array(F.lit("before")))))
    stats = hac_mean(rows, [*part, "stage"], ret, lags, order, least_mean=5)
    total = Window.partitionBy(*part)
    return stats.withColumn("frequency", F.try_divide("n_rows", F.max("n_rows").over(total))).drop("n_rows")


def apply_filters(df: DataFrame, proposals: DataFrame, features: list[str], part: list[str] = PART) -> DataFrame:
    """One row for each row and proposal of its series, with whether the filter keeps it; what is missing is not kept.

    proposals: (part, feature, midpoint, direction), as propose_filters() gives them.
    """
    long = df.withColumn("_f", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))).select("*", "_f.*").drop("_f")
    kept = F.when(F.col("direction") == "above", F.col("value") > F.col("midpoint")).otherwise(F.col("value") < F.col("midpoint"))
    # As many proposals as features for each series.
    return long.join(F.broadcast(proposals.select(*part, "feature", "midpoint", "direction")), [*part, "feature"]).withColumn("kept", truth(kept))


def compare_splits(inside: DataFrame, validation: DataFrame, test: DataFrame, part: list[str] = PART) -> DataFrame:
    """Three evaluations side by side; a mean whose sign is not the inside one, or that is missing, has collapsed."""
    keys = [*part, "rule_id"]
    named = lambda df, s: df.select(*keys, F.col("n").alias(f"n_{s}"), F.col("mean_ret").alias(f"mean_{s}"))
    out = named(inside, "in").join(named(validation, "val"), keys, "left").join(named(test, "test"), keys, "left")
    expected = F.signum("mean_in")
    return out.withColumns({f"collapsed_{s}": ~F.signum(f"mean_{s}").eqNullSafe(expected) for s in ("val", "test")})


def stability(by_period: DataFrame, expected: DataFrame, period: str, part: list[str] = PART) -> DataFrame:
    """For each rule the periods with 5 rows or more and the expected sign; one or none is single-period driven.

    expected: (part, rule_id, expected).
    """
    rows = by_period.join(expected, [*part, "rule_id"])
    fits = (F.col("n") >= 5) & (F.signum("mean_ret") == F.col("expected"))
    return rows.groupBy(*part, "rule_id").agg(F.count(F.lit(1)).alias("n_periods"), F.count_if(fits).alias("n_consistent")).withColumn("single_period", F.col("n_consistent") <= 1)


def time_of_day(df: DataFrame, ret: str = "ret_fwd_12", bar: str = "bar_in_session", early: int = 12, part: list[str] = PART) -> DataFrame:
    """Each rule's mean against the mean of its rows' times of day, and the share of its rows in the first hour."""
    rows = df.withColumn("rule_id", rule_id()).where(F.col(ret).isNotNull())
    usual = rows.groupBy(*part, bar).agg(F.avg(ret).alias("_usual"))
    out = rows.join(usual, [*part, bar]).groupBy(*part, "rule_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(ret).alias("mean_ret"), F.avg("_usual").alias("baseline"), F.avg((F.col(bar) <= early).cast("double")).alias("first_hour_share")
    )
    return out.withColumn("excess", F.col("mean_ret") - F.col("baseline"))


def shuffled(df: DataFrame, col: str, seed: int | Column = 42, part: list[str] = PART) -> DataFrame:
    """df with one column permuted inside each series, in an order fixed by the seed."""
    place = Window.partitionBy(*part).orderBy("bar_idx")
    drawn = Window.partitionBy(*part).orderBy(F.xxhash64(F.lit(seed), "bar_idx"), "bar_idx")
    values = df.select(*part, F.row_number().over(drawn).alias("_r"), F.col(col).alias("_v"))
    return df.withColumn("_r", F.row_number().over(place)).join(values, [*part, "_r"]).withColumn(col, F.col("_v")).drop("_v", "_r")


def verdict(comparison: DataFrame, stable: DataFrame, tod: DataFrame, share: float = 0.25, part: list[str] = PART) -> DataFrame:
    """survives: neither collapsed out of sample, nor driven by one period, nor explained by the time of day."""
    keys = [*part, "rule_id"]
    rows = comparison.join(stable.select(*keys, "single_period"), keys, "left").join(tod.select(*keys, "excess"), keys, "left")
    expected = F.signum("mean_in")
    kept = truth((F.signum("excess") == expected) & (F.abs("excess") >= share * F.abs("mean_in")))
    collapsed = F.col("collapsed_val") | F.col("collapsed_test")
    single = F.coalesce("single_period", F.lit(True))
    return rows.select(*keys, collapsed.alias("collapsed_oos"), single.alias("single_period"), (~kept).alias("tod_explained"), (~collapsed & ~single & kept).alias("survives"))
