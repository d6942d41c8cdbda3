"""Ordered building blocks and labels on tiny tables with expected values."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats as S
from tidemark.functions.tails import chi2_tail, t_tail
from tidemark.operators import asof, events, indicators, mtf, resample, rules
from tidemark.operators.sequence import ema, streak, with_bar_idx
from tidemark.sources import bars as B

T0 = datetime(2024, 1, 1, 9, 15)


def series(spark, closes, step=5, start=T0, name="s"):
    rows = [(name, start + timedelta(minutes=step * i), start + timedelta(minutes=step * (i + 1)), float(c)) for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "series_id string, timestamp timestamp_ntz, bar_close timestamp_ntz, close double")
    return df.withColumns({"open": F.col("close") - 0.1, "high": F.col("close") + 0.5, "low": F.col("close") - 0.5})


def values(df, col, order="bar_close"):
    return [r[0] for r in df.orderBy(order).select(col).collect()]


def walk(n, seed=42):
    import numpy as np

    return 12000 * np.cumprod(1 + np.random.default_rng(seed).normal(0.0002, 0.001, n))


def test_ema_is_recursive(spark):
    x = walk(500)
    got = values(ema(series(spark, x), {"e": ("close", 12), "f": ("close", 90)}), "e")
    assert got == pytest.approx(pd.Series(x).ewm(span=12, adjust=False).mean().tolist(), rel=1e-12)
    got = values(ema(series(spark, x), {"f": ("close", 90)}, block=16), "f")
    assert got == pytest.approx(pd.Series(x).ewm(span=90, adjust=False).mean().tolist(), rel=1e-12)


def test_indicator_invariants(spark):
    rows = indicators.features(series(spark, walk(600))).toPandas()
    bull = rows[rows.A_state == "bull_accel"]
    assert ((bull.A_hist > 0) & (bull.A_hist_slope > 0)).all() and len(bull)
    assert rows.B_zroc.notna().sum() <= 600 - 106 + 1
    assert rows.sort_values("bar_close").A_macd.iloc[0] == 0 and rows.sort_values("bar_close").A_state.iloc[0] is None
    assert (rows.B_gap_norm - rows.B_gap / rows.close).abs().max() == 0


def test_zero_cross_must_pass_zero(spark):
    df = series(spark, [-1, 0, 1, -1, 1])
    from tidemark.operators.sequence import by, zero_cross

    assert values(df.withColumn("z", zero_cross(F.col("close"), by())), "z") == [0, 0, 0, -1, 1]


def test_streak(spark):
    df = streak(series(spark, [1, 1, -1, 1, 1, 1]), F.col("close") > 0)
    assert values(df, "streak") == [1, 2, 0, 1, 2, 3]


def test_forward_returns_and_barriers(spark):
    out = indicators.forward_returns(series(spark, range(100, 110)))
    assert values(out, "ret_fwd_1")[0] == pytest.approx(0.01) and values(out, "ret_fwd_12") == [None] * 10
    up = indicators.triple_barrier(series(spark, [100.0, 100, 101] + [100] * 30), "5m")
    assert values(up, "barrier_hit")[0] == 1 and values(up, "barrier_hit")[-24:] == [None] * 24
    assert values(indicators.triple_barrier(series(spark, [100.0, 100, 99] + [100] * 30), "5m"), "barrier_hit")[0] == -1
    with pytest.raises(ValueError, match="unknown bar size"):
        indicators.triple_barrier(up, "2m")


def test_regime(spark):
    assert set(values(indicators.regime(series(spark, range(100, 140))), "regime")[19:]) == {"trend_up"}
    flat = values(indicators.regime(series(spark, [5.0] * 25)), "regime")
    assert flat[:19] == [None] * 19 and set(flat[19:]) == {"chop"}


def test_resample_day(spark):
    day = B.number_in_session(series(spark, range(1, 76)))
    quarter, hour, daily = resample.resample(day, 15), resample.resample(day, 60), resample.resample_daily(day)
    assert (quarter.count(), hour.count(), daily.count()) == (25, 6, 1)
    first = quarter.orderBy("bar_close").first()
    assert (first.high, first.close, first.bar_close) == (3.5, 3.0, datetime(2024, 1, 1, 9, 30))
    assert daily.first().bar_close == datetime(2024, 1, 1, 15, 30)
    early = B.number_in_session(series(spark, [1.0], start=datetime(2024, 1, 1, 9, 0)))
    with pytest.raises(Exception, match="bar before the session"):
        resample.resample(early, 15).collect()


def test_csv(spark, tmp_path):
    path = tmp_path / "bars.csv"
    path.write_text("open,high,low,close,volume,timestamp\n1,2,0,1,0,2020-11-09 09:15:00+05:30\n9,9,9,9,0,2020-11-09 09:15:00+05:30\n2,3,1,2,0,2020-11-09 09:20:00+05:30\n5,5,5,5,0,2020-11-09 16:00:00+05:30\n")
    got = B.read_csv_bars(spark, str(path)).orderBy("timestamp").collect()
    assert [(r.open, r.timestamp, r.bar_in_session) for r in got] == [(1.0, datetime(2020, 11, 9, 9, 15), 1), (2.0, datetime(2020, 11, 9, 9, 20), 2)]


def test_asof_takes_the_same_instant_and_never_later(spark):
    left, right = series(spark, range(30)), series(spark, range(10), step=15)
    got = asof.asof_backward(left, {"15m": right.select("series_id", "bar_close", "close")})
    assert got.count() == 30 and asof.lookahead_violations(got, ["15m"]).first().n_15m == 0
    assert values(got, "close_15m")[:4] == [None, None, 0.0, 0.0]


def test_followthrough_is_strictly_later(spark):
    low = series(spark, [0, 0, 1, 0, 0, 0]).withColumn("z", F.col("close").cast("int"))
    high = series(spark, [1, 0, 1, 0], step=15).withColumn("z", F.col("close").cast("int"))
    row = asof.followthrough(low, high, "z", "z", 3).first()
    assert (row.followed_through, row.lag_bars) == (True, 2.0)


def test_turns_and_peaks(spark):
    gap = [-1.0] * 15 + [0.5] + [-1.0] * 5
    rows = with_bar_idx(series(spark, gap)).withColumns({"B_gap": F.col("close"), "B_gap_acc": F.when(F.col("bar_idx").between(5, 7), 1.0).otherwise(-1.0)})
    got = events.early_turns(rows).collect()
    assert [(r.bar_idx, r.confirmed) for r in got] == [(7, True)]
    x = [100.0] * 60
    x[10], x[40] = 110, 120
    df = with_bar_idx(series(spark, x)).withColumn("rsi", F.when(F.col("bar_idx") == 10, 70.0).when(F.col("bar_idx") == 40, 60.0).otherwise(50.0))
    found = events.divergences(df, "close", "rsi").collect()
    assert [(r.peak_idx, r.confirm_idx, r.div_type) for r in found if r.div_type == "bearish"] == [(40, 45, "bearish")]


def test_plateaus_and_spacing():
    import numpy as np

    assert events.peak_positions(np.array([0, 1, 1, 1, 0, 5, 0]), 1).tolist() == [2, 5]
    assert events.peak_positions(np.array([0, 3, 0, 5, 0, 4, 0]), 3).tolist() == [3]


def test_confirmation_without_flips(spark):
    rows = with_bar_idx(series(spark, [1.0] * 5)).withColumn("z", F.lit(0))
    assert events.turn_confirmations(rows, "z", "close").count() == 0


@pytest.mark.parametrize("n,has_mean,has_t", [(4, False, False), (5, True, False), (19, True, False), (20, True, True)])
def test_hac_gates(spark, n, has_mean, has_t):
    rows = series(spark, [(i * 7919) % 13 - 5 for i in range(n)])
    got = S.hac_mean(rows, ["series_id"], "close", 3, least_mean=5).first()
    assert (got.mean_ret is not None, got.t_stat is not None, got.n) == (has_mean, has_t, n)


def test_hac_value(spark):
    import numpy as np

    x = walk(60) - 12000
    got = S.hac_mean(series(spark, x), ["series_id"], "close", 4).first().t_stat
    e = x - x.mean()
    s = (e * e).sum() + sum(2 * (1 - k / 5) * (e[k:] * e[:-k]).sum() for k in range(1, 5))
    assert got == pytest.approx(x.mean() / np.sqrt(s / (60 * 59)), rel=1e-9)


def test_cross_correlation_sign(spark):
    x = walk(200)
    df = series(spark, x).withColumn("b", F.lag("close", 3).over(__import__("tidemark.operators.sequence", fromlist=["by"]).by()))
    assert S.peak_lag(S.cross_correlation(df, "close", "b")).first().peak_lag == -3


def test_constant_feature_has_no_deciles_nor_correlation(spark):
    df = indicators.forward_returns(series(spark, walk(50))).withColumn("c", F.lit(1.0))
    assert S.deciles(df, "c", ["ret_fwd_1"]).count() == 0
    assert S.correlations(df, ["c"], ["ret_fwd_1"]).first()["corr"] is None


def test_scores(spark):
    cols = {name: F.lit(1.0) for name in [f"{i}{s}" for i in ("A_hist", "B_roc") for s in ("", "_15m", "_1h", "_1d")]}
    row = series(spark, [1]).withColumns(cols).select(mtf.score_bull().alias("b"), mtf.score_bear().alias("d"), rules.rule_id().alias("r")).first()
    assert tuple(row) == (8, 0, 255)


def test_hamming_dedupe(spark):
    ranked = spark.createDataFrame([("s", 1, 255), ("s", 2, 254), ("s", 3, 252), ("s", 4, 0)], "series_id string, place int, rule_id int")
    assert [r.rule_id for r in rules.dedupe(ranked).orderBy("place").collect()] == [255, 252, 0]


def test_tails():
    assert 2 * chi2_tail(3.84145882, 1) == pytest.approx(0.1, rel=1e-6)
    assert t_tail(2.0, 10) == pytest.approx(0.07338803, rel=1e-6)


def test_fdr(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, 0.04, 0.03, None])], "k string, i int, p double")
    got = {r.i: r.p_adj for r in S.fdr_bh(df, "p", ["k"], ["i"]).collect()}
    assert got[0] == pytest.approx(0.03) and got[1] == pytest.approx(0.04) and got[2] == pytest.approx(0.04) and got[3] is None


def test_stream_bars(spark, tmp_path):
    from tidemark.streaming import stream_bars

    schema = "series_id string, ts timestamp, event_id long, value double"
    spark.createDataFrame([("s", datetime(2024, 1, 1, 9, m), m, float(m)) for m in (0, 3, 6, 40)], schema).write.parquet(str(tmp_path / "in"))
    query = stream_bars(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("stream_bars").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r.open, r.close) for r in spark.table("stream_bars").collect()} == {(0.0, 3.0), (6.0, 6.0)}
