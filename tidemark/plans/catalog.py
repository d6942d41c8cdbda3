"""Registry of the driver's queries; their DuckDB equivalents are in oracles.py.

Bars are made from the driver's events, one series for each event type. Doubles are
rounded, since sums depend on the order of their terms.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import stats as S
from tidemark.operators import asof as J
from tidemark.operators import events as E
from tidemark.operators import indicators as I
from tidemark.operators import ml as ML
from tidemark.operators import mtf as M
from tidemark.operators import resample as R
from tidemark.operators import rules as Q
from tidemark.operators.sequence import ema
from tidemark.plans.oracles import ORACLES
from tidemark.schema import HIGHER, STATES, TIMEFRAMES, Spans
from tidemark.sources import bars as B

#: Rows dropped for warming up, and the short spans of the daily bars: the events last a month.
WARM, DAILY = 50, Spans(3, 6, 3, 5, 10, 2, 10)
RET, RETS = "ret_fwd_12", [f"ret_fwd_{n}" for n in (1, 3, 6, 12, 24)]
SHORT = ["ret_fwd_3", "ret_fwd_12"]
#: Splits in time: days of the month up to the first are for discovery, to the second for validation.
SPLIT = (18, 24)
TOP_RULE = 255

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


#: p-values, which SQL lacks.
P_VALUES = ["p_value", "p_b", "p_chi2", "p_bonf", "n_significant"]


def query_p(f):
    """Registers a table with p-values as name_p, and what SQL can say of it as name."""
    QUERIES[f"{f.__name__}_p"] = f
    QUERIES[f.__name__] = lambda spark, sf: f(spark, sf).drop(*P_VALUES)
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    kinds = {c: None if c in P_VALUES else kind for c, kind in df.dtypes}  # small ones would become 0
    zero = lambda c: F.round(c, digits) + F.lit(0.0)  # noqa: E731  no negative zero
    return df.select(*[zero(F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return B.event_ticks(spark.read.parquet(f"{sf}/events.parquet"))


def bars(spark: SparkSession, sf: str, tf: str = "5m") -> DataFrame:
    return B.tick_bars(ticks(spark, sf), TIMEFRAMES[tf].minutes)


def session(spark: SparkSession, sf: str) -> DataFrame:
    kept = bars(spark, sf).drop("session_date", "bar_in_session").where(B.in_session(F.col("timestamp")))
    return B.number_in_session(kept)


def frame(spark: SparkSession, sf: str, tf: str = "5m") -> DataFrame:
    return I.features(bars(spark, sf, tf), DAILY if tf == "1d" else Spans())


def targets(spark: SparkSession, sf: str, tf: str = "5m") -> DataFrame:
    return I.drop_warmup(I.forward_returns(frame(spark, sf, tf)), WARM)


_held: dict[tuple[str, str], DataFrame] = {}


def master(spark: SparkSession, sf: str) -> DataFrame:
    """The master table, which a session keeps for the data it last asked for: most queries below read it, some several times."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _held:
        for app, old in [(k[0], v) for k, v in _held.items()]:
            if app == key[0]:
                old.unpersist()
        _held.clear()
        frames = {"5m": targets(spark, sf), **{tf: frame(spark, sf, tf) for tf in HIGHER}}
        _held[key] = J.master(frames).persist(StorageLevel.MEMORY_AND_DISK)
    return _held[key]


def splits(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    day = F.dayofmonth("bar_close")
    return df.where(day <= SPLIT[0]), df.where((day > SPLIT[0]) & (day <= SPLIT[1])), df.where(day > SPLIT[1])


# Data layer


@query
def ohlc_bars_5m(spark, sf):
    return bars(spark, sf).select("series_id", "timestamp", "bar_close", "open", "high", "low", "close", "session_date", "bar_in_session")


@query
def dedupe_keep_first(spark, sf):
    rows = ticks(spark, sf).withColumn("minute", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    return B.keep_first(rows, ["series_id", "minute"], [F.col("ts"), F.col("event_id")]).select("series_id", "minute", "event_id", "value")


@query
def session_filter(spark, sf):
    return session(spark, sf).select("series_id", "timestamp", "close", "bar_in_session")


@query
def ohlc_sanity(spark, sf):
    moved = bars(spark, sf).withColumn("high", F.when(F.col("bar_in_session") % 7 == 0, F.col("low") - 1).otherwise(F.col("high")))
    return B.audit(moved)


@query
def resample_15m(spark, sf):
    return R.resample(session(spark, sf), 15).select("series_id", "timestamp", "bar_close", "open", "high", "low", "close", "bar_in_session")


@query
def resample_1h(spark, sf):
    return R.resample(session(spark, sf), 60).select("series_id", "timestamp", "bar_close", "open", "high", "low", "close", "bar_in_session")


@query
def resample_1d(spark, sf):
    return R.resample_daily(session(spark, sf)).select("series_id", "timestamp", "bar_close", "open", "high", "low", "close", "bar_in_session")


@query
def bars_per_session(spark, sf):
    return R.bars_per_session(session(spark, sf))


@query
def session_gaps(spark, sf):
    return R.session_gaps(session(spark, sf))


# Features


@query
def ema_12_90(spark, sf):
    return rounded(ema(bars(spark, sf), {"ema_12": ("close", 12), "ema_90": ("close", 90)}).select("series_id", "bar_close", "ema_12", "ema_90"))


@query
def indicator_a(spark, sf):
    return rounded(I.indicator_a(bars(spark, sf)).select("series_id", "bar_close", "A_macd", "A_signal", "A_hist", "A_hist_slope", "A_macd_sign", "A_hist_sign", "A_macd_zero_cross", "A_hist_zero_cross", "A_state"))


@query
def indicator_b(spark, sf):
    out = I.indicator_b(bars(spark, sf))
    sure = F.col("B_roc_invalid") == 0
    return rounded(out.select("series_id", "bar_close", "B_gap", F.when(sure, F.round("B_roc", 3)).alias("B_roc"), "B_roc_invalid", "B_gap_acc", "B_zroc_extreme", "B_state"))


@query
def zero_cross_events(spark, sf):
    return I.indicator_a(bars(spark, sf)).where("A_hist_zero_cross <> 0").select("series_id", "bar_close", F.col("A_hist_zero_cross").alias("direction"))


@query
def quadrant_state(spark, sf):
    return I.indicator_a(bars(spark, sf, "15m")).select("series_id", "bar_close", "A_state")


@query
def rolling_zscore(spark, sf):
    return rounded(I.indicator_b(bars(spark, sf)).where("B_zroc is not null").select("series_id", "bar_close", "B_zroc"), 4)


@query
def roc_invalid_flag(spark, sf):
    return I.indicator_b(bars(spark, sf)).groupBy("series_id").agg(F.sum("B_roc_invalid").alias("n_invalid"), F.count(F.lit(1)).alias("n_rows"))


@query
def state_distribution(spark, sf):
    counts = frame(spark, sf).where("A_state is not null").groupBy("series_id", "A_state").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("series_id"))
    return rounded(counts.withColumn("share", F.col("n") / total))


@query
def warmup_drop(spark, sf):
    return I.drop_warmup(bars(spark, sf), WARM).select("series_id", "bar_close", "bar_idx", "close")


# Joins in time


@query
def asof_join_backward(spark, sf):
    right = bars(spark, sf, "1h").select("series_id", "bar_close", "close")
    return J.asof_backward(bars(spark, sf).select("series_id", "bar_close", "close"), {"1h": right})


@query
def master_multi_tf(spark, sf):
    m = master(spark, sf)
    return rounded(m.select("series_id", "bar_close", "bar_close_15m", "bar_close_1h", "bar_close_1d", "A_hist", "A_hist_15m", "A_hist_1h", "A_hist_1d", "A_state", "A_state_15m", "B_state_1h"))


@query
def no_lookahead_violations(spark, sf):
    return J.lookahead_violations(master(spark, sf))


@query
def extract_tf(spark, sf):
    out = J.extract_tf(master(spark, sf), "1h")
    return rounded(out.select("series_id", "bar_close", "close", "A_hist", "A_state"))


# Labels


@query
def forward_returns(spark, sf):
    return rounded(I.forward_returns(bars(spark, sf)).select("series_id", "bar_close", *RETS))


@query
def triple_barrier(spark, sf):
    return I.triple_barrier(bars(spark, sf, "1h"), "1h").select("series_id", "bar_close", "barrier_hit")


@query
def regime_label(spark, sf):
    return I.regime(bars(spark, sf, "15m")).select("series_id", "bar_close", "regime")


# Statistics


@query
def state_conditional_returns(spark, sf):
    """Flagship: returns after each state of the 5m indicator."""
    rows = targets(spark, sf).where("A_state is not null")
    made = rows.groupBy("series_id", "A_state").agg(F.count(F.lit(1)).alias("n"), F.count(RET).alias("n_ret"), F.avg(RET).alias("mean_ret"), F.avg((F.col(RET) > 0).cast("double")).alias("hit_rate"))
    return rounded(made)


@query_p
def hac_mean_by_state(spark, sf):
    long = targets(spark, sf).where("A_state is not null").unpivot(["series_id", "A_state", "bar_close"], SHORT, "horizon", "ret")
    return rounded(S.hac_mean(long, ["series_id", "A_state", "horizon"]), 5)


@query
def corr_pearson(spark, sf):
    return rounded(S.correlations(targets(spark, sf), ["A_hist", "A_macd", "B_gap"], SHORT))


@query
def corr_spearman(spark, sf):
    return rounded(S.rank_correlations(targets(spark, sf), ["A_hist", "B_gap"], SHORT))


@query
def decile_returns(spark, sf):
    return rounded(S.deciles(targets(spark, sf), "A_hist", SHORT), 5)


@query
def cross_correlation(spark, sf):
    return rounded(S.cross_correlation(targets(spark, sf), "A_hist", "B_gap"))


@query
def cross_correlation_peak(spark, sf):
    return S.peak_lag(S.cross_correlation(targets(spark, sf), "A_hist", "B_gap"))


@query_p
def nested_ols_hac(spark, sf):
    return rounded(S.nested_ols(targets(spark, sf), RET, "A_hist", "B_gap"), 5)


@query_p
def joint_state_matrix(spark, sf):
    return rounded(S.joint_states(targets(spark, sf), "A_state", "B_state", RET), 5)


@query_p
def joint_state_chi2(spark, sf):
    return rounded(S.chi_square(S.joint_states(targets(spark, sf), "A_state", "B_state", RET)), 5)


@query
def fdr_bh(spark, sf):
    """All orders, whose statuses are the families; p is a fixed fraction of the price, the point being the adjustment."""
    p = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus", (F.col("o_totalprice") / 1e6).alias("p"))
    return rounded(S.fdr_bh(p, "p", ["o_orderstatus"], ["o_orderkey"]))


# Event studies


@query
def peak_transition_events(spark, sf):
    return rounded(E.peak_transitions(targets(spark, sf)).select("series_id", "bar_close", *SHORT))


@query
def peak_transition_summary(spark, sf):
    return rounded(E.transition_returns(E.peak_transitions(targets(spark, sf)), SHORT), 5)


@query
def aligned_vs_tired(spark, sf):
    return rounded(E.aligned_or_tired(targets(spark, sf)).select("series_id", "bar_close", "group", RET))


@query
def pullback_split(spark, sf):
    return rounded(E.pullbacks(targets(spark, sf)).select("series_id", "bar_close", "group", RET))


@query
def zroc_term_structure(spark, sf):
    return rounded(E.bucket_means(targets(spark, sf), SHORT), 5)


@query
def early_turn_runs(spark, sf):
    return E.early_turns(targets(spark, sf)).select("series_id", "bar_close", "streak", "confirmed")


@query
def early_turn_summary(spark, sf):
    return rounded(E.early_turn_summary(E.early_turns(targets(spark, sf))))


@query
def aligned_vs_tired_means(spark, sf):
    return rounded(E.group_means(E.aligned_or_tired(targets(spark, sf)), SHORT), 5)


@query
def pullback_means(spark, sf):
    return rounded(E.group_means(E.pullbacks(targets(spark, sf)), SHORT), 5)


@query
def turn_confirmation(spark, sf):
    return E.turn_confirmations(targets(spark, sf), "A_hist_zero_cross", "B_gap_acc")


@query
def turn_confirmation_summary(spark, sf):
    return rounded(E.confirmation_summary(E.turn_confirmations(targets(spark, sf), "A_hist_zero_cross", "B_gap_acc")))


@query
def local_maxima_candidates(spark, sf):
    return E.local_maxima(bars(spark, sf), "close").select("series_id", "bar_close", "close")


@query
def local_peaks(spark, sf):
    return E.local_peaks(bars(spark, sf), "close")


@query
def divergence_events(spark, sf):
    return E.divergences(targets(spark, sf), "close", "A_hist")


@query
def divergence_returns(spark, sf):
    t = targets(spark, sf)
    return rounded(E.divergence_returns(E.divergences(t, "close", "A_hist"), t, SHORT), 5)


@query
def compression_expansion(spark, sf):
    return E.compressions(frame(spark, sf, "15m"))


@query
def squeeze_event_study(spark, sf):
    t = I.forward_returns(frame(spark, sf, "15m"))
    return rounded(E.squeeze_returns(E.compressions(t), t, SHORT), 5)


@query
def squeeze_on_master(spark, sf):
    """Expansions of the 15m bars, with the 5m returns from the first row that saw them."""
    m = master(spark, sf)
    return rounded(E.squeeze_returns(E.at_first_lower_row(E.compressions(frame(spark, sf, "15m")), m, "bar_close_15m"), m, SHORT), 5)


# Across bar sizes


@query_p
def stratify_htf_state(spark, sf):
    return rounded(M.stratify(master(spark, sf), F.col("A_state") == "bull_accel", "A_state_1h", "bar_close_1h", SHORT), 5)


@query
def cross_tf_followthrough(spark, sf):
    low, high = frame(spark, sf, "15m"), frame(spark, sf, "1h")
    return J.followthrough(low, high, "A_hist_zero_cross", "A_hist_zero_cross", 4).select("series_id", "bar_close", "direction", "followed_through", "lag_bars")


@query
def transition_summary(spark, sf):
    return rounded(M.transition_summary(cross_tf_followthrough(spark, sf)))


@query
def score_bull(spark, sf):
    return M.with_scores(master(spark, sf)).select("series_id", "bar_close", "score_bull")


@query
def score_bull_accel(spark, sf):
    return M.with_scores(master(spark, sf)).select("series_id", "bar_close", "score_bull_accel")


@query
def score_bear(spark, sf):
    return M.with_scores(master(spark, sf)).select("series_id", "bar_close", "score_bear")


@query
def score_distribution(spark, sf):
    return M.with_scores(master(spark, sf)).groupBy("series_id", "score_bull").agg(F.count(F.lit(1)).alias("n"))


@query_p
def score_bucketed_returns(spark, sf):
    return rounded(M.score_returns(M.with_scores(master(spark, sf)), "score_bull", SHORT), 5)


@query
def bull_bear_asymmetry(spark, sf):
    m = M.with_scores(master(spark, sf))
    return rounded(M.asymmetry(M.score_returns(m, "score_bull", SHORT), M.score_returns(m, "score_bear", SHORT)), 5)


@query
def asymmetry_summary(spark, sf):
    m = M.with_scores(master(spark, sf))
    return rounded(M.asymmetry_summary(M.asymmetry(M.score_returns(m, "score_bull", SHORT), M.score_returns(m, "score_bear", SHORT))), 5)


@query
def score_monotonicity(spark, sf):
    return rounded(M.score_monotonicity(M.score_returns(M.with_scores(master(spark, sf)), "score_bull", SHORT)), 5)


@query
def score_returns_wide(spark, sf):
    long = M.score_returns(M.with_scores(master(spark, sf)), "score_bull", SHORT)
    return rounded(M.wide(long, ["series_id", "score"], "horizon", SHORT, "mean_ret"), 5)


@query
def joint_state_wide(spark, sf):
    return M.wide(S.joint_states(targets(spark, sf), "A_state", "B_state", RET), ["series_id", "state_a"], "state_b", list(STATES), "n")


# Rules


#: The rules that are carried to validation, in the order in which they were listed.
CARRIED = [255, 0, 151, 31]


@query
def carried_rules(spark, sf):
    return rounded(Q.carry(Q.evaluate(master(spark, sf)), CARRIED).select("series_id", "place", "rule_id", "n", "mean_ret"), 5)


@query
def rule_enumeration(spark, sf):
    return Q.enumerate_rules(spark)


@query_p
def rule_evaluation_256(spark, sf):
    return rounded(Q.evaluate(master(spark, sf)), 5)


@query
def rule_topk(spark, sf):
    return rounded(Q.rank(Q.evaluate(master(spark, sf)), 5), 5)


@query
def rule_hamming_dedupe(spark, sf):
    return Q.dedupe(Q.rank(Q.evaluate(master(spark, sf)), 20).where("side = 'top'"))


@query
def rule_active_flags(spark, sf):
    return Q.enumerate_rules(spark).select("rule_id", Q.active_flags().alias("flags"))


@query
def worked_failed_split(spark, sf):
    return rounded(Q.worked_failed(master(spark, sf), TOP_RULE))


def differences(spark, sf):
    rows = Q.with_outcome(master(spark, sf).where("A_state = 'bull_accel'"), RET)
    return S.mean_difference(rows, "worked", ["A_hist", "A_macd", "B_gap", "A_hist_1h", "B_gap_1h"])


@query_p
def feature_mean_diff(spark, sf):
    return rounded(differences(spark, sf), 5)


@query
def propose_filters(spark, sf):
    found = Q.propose_filters(differences(spark, sf), 0.05)
    return rounded(found.select("series_id", "feature", "cohens_d", "midpoint", "direction"), 5)


@query
def filters_applied(spark, sf):
    """Every proposed filter on the rows that it was proposed for: how many it keeps, and their mean return."""
    rows = Q.with_outcome(master(spark, sf).where("A_state = 'bull_accel'"), RET)
    features = ["A_hist", "A_macd", "B_gap", "A_hist_1h", "B_gap_1h"]
    made = Q.apply_filters(rows, Q.propose_filters(S.mean_difference(rows, "worked", features), 0.05), features)
    return rounded(made.groupBy("series_id", "feature").agg(F.count(F.lit(1)).alias("n_before"), F.count_if("kept").alias("n_after"), F.avg(F.when(F.col("kept"), F.col(RET))).alias("mean_after")), 5)


@query_p
def filter_before_after(spark, sf):
    return rounded(Q.before_after(master(spark, sf), F.col("A_state") == "bull_accel", F.col("A_hist_1h") > 0), 5)


# Validation


@query
def walk_forward_split(spark, sf):
    day = F.dayofmonth("bar_close")
    name = F.when(day <= SPLIT[0], "discovery").when(day <= SPLIT[1], "validation").otherwise("test")
    return targets(spark, sf).groupBy("series_id", name.alias("split")).agg(F.count(F.lit(1)).alias("n"), F.min("bar_close").alias("first"), F.max("bar_close").alias("last"))


def compared(spark, sf):
    return Q.compare_splits(*[Q.evaluate(part) for part in splits(master(spark, sf))])


@query
def oos_comparison(spark, sf):
    return rounded(compared(spark, sf), 5)


def stable(spark, sf):
    m = master(spark, sf).withColumn("period", F.floor((F.dayofmonth("bar_close") - 1) / 10).cast("int"))
    expected = Q.evaluate(m).select("series_id", "rule_id", F.signum("mean_ret").alias("expected"))
    return Q.stability(Q.evaluate(m, keys=["period"]), expected, "period")


@query
def rule_year_stability(spark, sf):
    return stable(spark, sf)


@query
def time_of_day_baseline(spark, sf):
    return rounded(Q.time_of_day(master(spark, sf)), 5)


@query
def shuffle_baseline(spark, sf):
    m = master(spark, sf)
    dealt = Q.evaluate(Q.shuffled(m, "A_hist")).select("series_id", "rule_id", F.col("mean_ret").alias("mean_shuffled"))
    real = Q.evaluate(m).where("n >= 20").join(dealt, ["series_id", "rule_id"])
    return rounded(real.select("series_id", "rule_id", "n", "mean_ret", "mean_shuffled", (F.try_divide("mean_shuffled", "mean_ret") * 100).alias("edge_retained_pct")))


@query
def rule_verdict(spark, sf):
    return Q.verdict(compared(spark, sf), stable(spark, sf), Q.time_of_day(master(spark, sf)))


# Models


def matrix(spark, sf):
    return ML.feature_matrix(master(spark, sf))


@query
def ml_feature_matrix(spark, sf):
    return rounded(matrix(spark, sf).select("series_id", "bar_close", "bar_in_session", "A_hist", "A_state", "B_state_1h", "A_hist_zero_cross_15m", "y"))


@query
def class_balance(spark, sf):
    return rounded(ML.class_balance(matrix(spark, sf)))


@query
def roc_auc(spark, sf):
    return rounded(S.roc_auc(matrix(spark, sf), "y", "A_hist"))


#: All features; boosting rounds and shuffles of a feature as in the reference.
MODEL_COLUMNS, TREES, REPEATS = ML.feature_columns(), 200, 10


_models: dict = {}


def fitted(spark, sf):
    """The model, which a session keeps for the data it last asked for: three queries read it; and the rows held out."""
    rows = matrix(spark, sf).select("series_id", "bar_close", "y", *MODEL_COLUMNS)
    inside, held, _ = splits(rows)
    key = (spark.sparkContext.applicationId if spark else None, sf)
    if key not in _models:
        _models.clear()
        _models[key] = ML.train(inside, MODEL_COLUMNS, trees=TREES)
    return _models[key], held


@query
def gbt_auc(spark, sf):
    model, held = fitted(spark, sf)
    return ML.auc(model, held, MODEL_COLUMNS)


@query
def permutation_importance(spark, sf):
    model, held = fitted(spark, sf)
    return ML.permutation_importance(model, held, MODEL_COLUMNS, MODEL_COLUMNS, repeats=REPEATS)


@query
def top_splits(spark, sf):
    model, _ = fitted(spark, sf)
    return spark.createDataFrame(ML.top_splits(model, MODEL_COLUMNS), "feature string, threshold double, gain double")


assert set(ORACLES) <= set(QUERIES), set(ORACLES) - set(QUERIES)
