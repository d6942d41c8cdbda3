"""Queries and operators that once did less than the whole job, against brute force on small tables."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats as S
from tidemark.functions.tails import chi2_tail
from tidemark.operators import ml, rules
from tidemark.operators.sequence import with_bar_idx
from tidemark.plans import catalog


def brute_bh(rows):
    out = {}
    for family in {s for _, s, _ in rows}:
        mine = sorted((price / 1e6, key) for key, s, price in rows if s == family)
        least = 1.0
        for rank in range(len(mine), 0, -1):
            p, key = mine[rank - 1]
            least = min(least, p * len(mine) / rank)
            out[key] = least
    return out


def test_fdr_of_all_orders(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, rng.choice("FOP"), float(rng.randrange(1000, 400000))) for k in range(1, 301)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_orderkey: r.p_adj for r in catalog.QUERIES["fdr_bh"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(brute_bh(rows), abs=1e-6)


def test_models_see_all_features(monkeypatch):
    seen = {}
    monkeypatch.setattr(catalog, "matrix", lambda spark, sf: type("Matrix", (), {"select": lambda self, *cols: cols})())
    monkeypatch.setattr(catalog, "splits", lambda rows: (rows, rows, rows))
    monkeypatch.setattr(ml, "train", lambda rows, cols, **k: seen.update(cols=cols, **k))
    monkeypatch.setattr(ml, "permutation_importance", lambda model, held, cols, tried, **k: seen.update(tried=tried, **k))
    catalog.QUERIES["permutation_importance"](None, "")
    assert seen == {"cols": ml.feature_columns(), "trees": 200, "tried": ml.feature_columns(), "repeats": 10}


def test_importance_of_all_repeats(spark):
    rng = random.Random(1)
    rows = [(f"s{k % 2}", k, rng.random(), rng.random()) for k in range(200)]
    df = spark.createDataFrame([(s, datetime(2024, 1, 1) + timedelta(hours=k), a, b, int(a > 0.5)) for s, k, a, b in rows], "series_id string, bar_close timestamp, a double, b double, y int")
    model = ml.train(df, ["a", "b"], trees=2)
    got = {r.feature: r for r in ml.permutation_importance(model, df, ["a", "b"], ["a", "b"], repeats=3).collect()}
    base = ml.auc(model, df, ["a", "b"]).first()["auc"]
    one_by_one = [base - ml.auc(model, rules.shuffled(with_bar_idx(df), "a", 42 + k), ["a", "b"]).first()["auc"] for k in range(3)]
    assert got["a"].mean_drop == pytest.approx(sum(one_by_one) / 3) and got["a"].sd_drop > 0 and got["b"].mean_drop == 0


def test_p_values(spark):
    t0 = datetime(2024, 1, 1)
    rng = random.Random(2)
    rows = [("s", t0 + timedelta(hours=k), rng.gauss(0.3, 1)) for k in range(60)]
    got = S.hac_mean(spark.createDataFrame(rows, "series_id string, bar_close timestamp, ret double"), ["series_id"]).first()
    assert got.p_value == pytest.approx(math.erfc(abs(got.t_stat) / math.sqrt(2)))
    few = S.hac_mean(spark.createDataFrame(rows[:19], "series_id string, bar_close timestamp, ret double"), ["series_id"])
    assert few.select("p_value", S.bonferroni(F.col("p_value"), 256).alias("b")).first()[:] == (None, None)
    ols = S.nested_ols(spark.createDataFrame([(s, t, y, rng.random(), rng.random()) for s, t, y in rows], "series_id string, bar_close timestamp, y double, a double, b double"), "y", "a", "b").first()
    assert ols.p_b == pytest.approx(math.erfc(abs(ols.t_b) / math.sqrt(2)))
    # Equal sizes and variances: Welch's degrees of freedom are 2 * (5 - 1), and t = -1 has p = 0.3465935.
    two = [("s", on, float(x + (not on))) for on in (True, False) for x in (1, 2, 3, 4, 5)]
    diff = S.mean_difference(spark.createDataFrame(two, "series_id string, side boolean, x double"), "side", ["x"]).first()
    assert (diff.t_stat, diff.p_value) == (pytest.approx(-1), pytest.approx(0.3465935, rel=1e-6))
    # Nine degrees of freedom: 16.918978 is the 95th percentile.
    states = ["bull_accel", "bull_decel", "bear_decel", "bear_accel"]
    cells = [("s", a, b, 30 if a == b else 20, 0.0, 0.01 if a == b else 0.5) for a in states for b in states]
    chi = S.chi_square(spark.createDataFrame(cells, "series_id string, state_a string, state_b string, n long, mean_ret double, p_value double")).first()
    assert chi.n_significant == 4 and chi.p_chi2 == pytest.approx(chi2_tail(chi.chi2, 9)) and chi2_tail(16.918978, 9) == pytest.approx(0.05, rel=1e-6)


def test_queries_of_p_values_are_registered():
    assert {"hac_mean_by_state_p", "rule_evaluation_256_p", "feature_mean_diff_p", "joint_state_chi2_p", "nested_ols_hac_p"} <= set(catalog.QUERIES)
