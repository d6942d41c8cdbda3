"""DuckDB SQL for the catalog's queries, composed from named table expressions."""

from __future__ import annotations

from math import ceil, log

#: Named expressions: what each needs, and its SQL.
CTES: dict[str, tuple[tuple[str, ...], str]] = {}
ORACLES: dict[str, str] = {}
W = "(PARTITION BY series_id ORDER BY bar_close)"


def rows(a: str, b: str) -> str:
    return f"(PARTITION BY series_id ORDER BY bar_close ROWS BETWEEN {a} AND {b})"


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (needs, sql)


def oracle(name: str, sql: str, *needs: str) -> None:
    order: list[str] = []

    def add(n: str) -> None:
        for m in CTES[n][0]:
            add(m)
        if n not in order:
            order.append(n)

    for n in needs:
        add(n)
    ORACLES[name] = ("WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" if order else "") + sql


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name or expr}"


def ema(x: str, span: int) -> str:
    a = 2.0 / (span + 1)
    far = ceil(18 * log(10) / -log(1 - a))
    return f"list_reduce(list({x}) OVER {rows(f'{far} PRECEDING', 'CURRENT ROW')}, lambda a, v: a * {1 - a!r} + v * {a!r})"


def state(level: str, slope: str) -> str:
    return (
        f"last_value(CASE WHEN {level} > 0 AND {slope} > 0 THEN 'bull_accel' WHEN {level} > 0 AND {slope} <= 0 THEN 'bull_decel' WHEN {level} < 0 AND {slope} >= 0 THEN 'bear_decel' "
        f"WHEN {level} < 0 AND {slope} < 0 THEN 'bear_accel' WHEN {level} = 0 AND {slope} > 0 THEN 'bear_decel' WHEN {level} = 0 AND {slope} < 0 THEN 'bull_decel' END IGNORE NULLS) OVER {rows('UNBOUNDED PRECEDING', 'CURRENT ROW')}"
    )


def cross(x: str) -> str:
    return f"CASE WHEN lag({x}) OVER {W} < 0 AND {x} > 0 THEN 1 WHEN lag({x}) OVER {W} > 0 AND {x} < 0 THEN -1 ELSE 0 END::INTEGER"


MINUTES = {"5m": 5, "15m": 15, "1h": 60, "1d": 1440}
HIGHER = ("15m", "1h", "1d")
HORIZONS = (1, 3, 6, 12, 24)

cte("ticks", "SELECT event_type AS series_id, ts, event_id, value FROM events WHERE value IS NOT NULL AND NOT isnan(value)")
for tf, m in MINUTES.items():
    cte(
        f"b_{tf}",
        f"""SELECT *, "timestamp" + INTERVAL {m} MINUTE AS bar_close, CAST("timestamp" AS DATE) AS session_date,
        row_number() OVER (PARTITION BY series_id, CAST("timestamp" AS DATE) ORDER BY "timestamp")::INTEGER AS bar_in_session
        FROM (SELECT series_id, time_bucket(INTERVAL {m} MINUTE, ts) AS "timestamp", arg_min(value, row(ts, event_id)) AS open, max(value) AS high,
        min(value) AS low, arg_max(value, row(ts, event_id)) AS close FROM ticks GROUP BY ALL)""",
        "ticks",
    )
    fast, slow, sig, g1, g2, roc, z = (3, 6, 3, 5, 10, 2, 10) if tf == "1d" else (12, 26, 9, 40, 90, 7, 100)
    cte(f"e_{tf}", f"SELECT *, {ema('close', fast)} AS e1, {ema('close', slow)} AS e2, {ema('close', g1)} AS e3, {ema('close', g2)} AS e4, (row_number() OVER {W} - 1)::INTEGER AS bar_idx FROM b_{tf}", f"b_{tf}")
    cte(f"m_{tf}", f"SELECT *, {ema('A_macd', sig)} AS A_signal, lag(B_gap, {roc}) OVER {W} AS prev FROM (SELECT *, e1 - e2 AS A_macd, e3 - e4 AS B_gap FROM e_{tf})", f"e_{tf}")
    cte(f"h_{tf}", f"SELECT *, A_macd - A_signal AS A_hist, B_gap / nullif(close, 0) AS B_gap_norm, CASE WHEN prev = 0 THEN 0.0 ELSE 100.0 * (B_gap - prev) / prev END AS B_roc, B_gap - prev AS B_gap_acc FROM m_{tf}", f"m_{tf}")
    cte(
        f"s_{tf}",
        f"""SELECT *, A_hist - lag(A_hist) OVER {W} AS A_hist_slope, B_roc - lag(B_roc) OVER {W} AS B_roc_slope,
        CASE WHEN count(B_roc) OVER {rows(f'{z - 1} PRECEDING', 'CURRENT ROW')} = {z} THEN
        (B_roc - avg(B_roc) OVER {rows(f'{z - 1} PRECEDING', 'CURRENT ROW')}) / nullif(stddev_samp(B_roc) OVER {rows(f'{z - 1} PRECEDING', 'CURRENT ROW')}, 0) END AS B_zroc,
        coalesce(abs(prev) < quantile_cont(abs(prev), 0.01) OVER (PARTITION BY series_id), false)::INTEGER AS B_roc_invalid FROM h_{tf}""",
        f"h_{tf}",
    )
    cte(
        f"f_{tf}",
        f"""SELECT *, sign(A_macd)::INTEGER AS A_macd_sign, sign(A_hist)::INTEGER AS A_hist_sign, {cross('A_macd')} AS A_macd_zero_cross, {cross('A_hist')} AS A_hist_zero_cross,
        {state('A_hist', 'A_hist_slope')} AS A_state, {state('B_roc', 'B_roc_slope')} AS B_state, coalesce(abs(B_zroc) > 2, false)::INTEGER AS B_zroc_extreme FROM s_{tf}""",
        f"s_{tf}",
    )
LEADS = ", ".join(f"lead(close, {n}) OVER {W} / nullif(close, 0) - 1 AS ret_fwd_{n}" for n in HORIZONS)
cte("t", f"SELECT * REPLACE ((bar_idx - 50)::INTEGER AS bar_idx) FROM (SELECT *, {LEADS} FROM f_5m) WHERE bar_idx >= 50", "f_5m")
cte("s5", """SELECT series_id, "timestamp", bar_close, open, high, low, close, session_date, row_number() OVER (PARTITION BY series_id, session_date ORDER BY "timestamp")::INTEGER AS bar_in_session
    FROM b_5m WHERE "timestamp"::TIME BETWEEN TIME '09:15:00' AND TIME '15:29:00'""", "b_5m")  # fmt: skip
joins = " ".join(f"ASOF LEFT JOIN f_{tf} AS x{tf} ON t.series_id = x{tf}.series_id AND t.bar_close >= x{tf}.bar_close" for tf in HIGHER)
IND = ("A_hist", "B_roc", "B_gap", "A_state", "B_state", "A_hist_zero_cross")
picked = ", ".join(f"x{tf}.{c} AS {c}_{tf}" for tf in HIGHER for c in ("bar_close", *IND))
FLAG_COLS = [c if tf == "5m" else f"{c}_{tf}" for tf in MINUTES for c in ("A_hist", "B_roc")]
bull = " + ".join(f"coalesce({c} > 0, false)::INTEGER" for c in FLAG_COLS)
bear = " + ".join(f"coalesce({c} < 0, false)::INTEGER" for c in FLAG_COLS)
accel = " + ".join(f"coalesce({c if tf == '5m' else f'{c}_{tf}'} = 'bull_accel', false)::INTEGER" for tf in MINUTES for c in ("A_state", "B_state"))
rule = " + ".join(f"coalesce({c} > 0, false)::INTEGER * {1 << i}" for i, c in enumerate(FLAG_COLS))
cte("mm", f"SELECT t.*, {picked} FROM t {joins}", "t", "f_15m", "f_1h", "f_1d")
cte("ms", f"SELECT *, ({bull})::INTEGER AS score_bull, ({bear})::INTEGER AS score_bear, ({accel})::INTEGER AS score_bull_accel, ({rule})::INTEGER AS rule_id FROM mm", "mm")


def hac(source: str, keys: str, value: str = "ret", lags: int = 12, least_mean: int = 0) -> str:
    """n_rows, n, mean_ret, hit_rate and t_stat by key."""
    w = f"(PARTITION BY {keys} ORDER BY bar_close)"
    lagged = ", ".join(f"e * lag(e, {k}) OVER {w} AS l{k}" for k in range(1, lags + 1))
    s = " + ".join(["sum(e * e)"] + [f"{2 * (1 - k / (lags + 1))!r} * coalesce(sum(l{k}), 0)" for k in range(1, lags + 1)])
    return f"""SELECT {keys}, n_rows, n, CASE WHEN n >= {least_mean} THEN mean_ret END AS mean_ret, CASE WHEN n >= {least_mean} THEN hit_rate END AS hit_rate,
    CASE WHEN n >= 20 AND s > 0 THEN mean_ret / sqrt(s / (n * (n - 1))) END AS t_stat FROM (
    SELECT {keys}, count(*) AS n_rows, count(x) AS n, avg(x) AS mean_ret, avg((x > 0)::INTEGER::DOUBLE) AS hit_rate, {s} AS s FROM (
    SELECT *, {lagged} FROM (SELECT {keys}, bar_close, {value} AS x, {value} - avg({value}) OVER (PARTITION BY {keys}) AS e FROM {source} WHERE {value} IS NOT NULL)
    UNION ALL BY NAME SELECT {keys}, bar_close FROM {source} WHERE {value} IS NULL) GROUP BY {keys})"""


def long(source: str, keys: str, value: str = "ret") -> str:
    return " UNION ALL ".join(f"SELECT {keys}, bar_close, '{h}' AS horizon, {h} AS {value} FROM {source}" for h in ("ret_fwd_3", "ret_fwd_12"))


def pearson(x: str, y: str) -> str:
    x, y = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    return f"covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0)"


BAR = 'series_id, "timestamp", bar_close, open, high, low, close'
oracle("ohlc_bars_5m", f"SELECT {BAR}, session_date, bar_in_session FROM b_5m", "b_5m")
oracle("dedupe_keep_first", "SELECT series_id, minute, event_id, value FROM (SELECT *, date_trunc('minute', ts) AS minute, row_number() OVER (PARTITION BY series_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS n FROM ticks) WHERE n = 1", "ticks")
oracle("session_filter", 'SELECT series_id, "timestamp", close, bar_in_session FROM s5', "s5")
oracle("ohlc_sanity", "SELECT series_id, count(*) AS n_rows, count(*) FILTER (high < greatest(open, close)) AS n_bad_high, count(*) FILTER (low > least(open, close)) AS n_bad_low FROM (SELECT * REPLACE (CASE WHEN bar_in_session % 7 = 0 THEN low - 1 ELSE high END AS high) FROM b_5m) GROUP BY series_id", "b_5m")
for name, m in (("15m", 15), ("1h", 60)):
    oracle(
        f"resample_{name}",
        f"""SELECT {BAR}, row_number() OVER (PARTITION BY series_id, "timestamp"::DATE ORDER BY "timestamp")::INTEGER AS bar_in_session FROM (
        SELECT series_id, min("timestamp") AS "timestamp", min("timestamp") + INTERVAL {m} MINUTE AS bar_close, arg_min(open, "timestamp") AS open, max(high) AS high, min(low) AS low, arg_max(close, "timestamp") AS close
        FROM (SELECT *, (epoch("timestamp" - session_date::TIMESTAMP)::BIGINT - 33300) // {60 * m} AS bin FROM s5) {"WHERE bin * 60 < 360" if m == 60 else ""} GROUP BY series_id, session_date, bin)""",
        "s5",
    )
oracle("resample_1d", """SELECT series_id, min("timestamp") AS "timestamp", session_date::TIMESTAMP + INTERVAL 930 MINUTE AS bar_close, arg_min(open, "timestamp") AS open, max(high) AS high, min(low) AS low, arg_max(close, "timestamp") AS close, 1::INTEGER AS bar_in_session FROM s5 GROUP BY series_id, session_date""", "s5")
oracle("bars_per_session", "SELECT series_id, session_date, count(*) AS n_bars FROM s5 GROUP BY ALL", "s5")
oracle("session_gaps", """SELECT series_id, session_date, count(*) FILTER (gap) AS n_gaps FROM (SELECT *, "timestamp" - lag("timestamp") OVER (PARTITION BY series_id, session_date ORDER BY "timestamp") > INTERVAL 5 MINUTE AS gap FROM s5) GROUP BY ALL HAVING count(*) FILTER (gap) > 0""", "s5")
oracle("ema_12_90", f"SELECT series_id, bar_close, {r('e1', 'ema_12')}, {r('e4', 'ema_90')} FROM e_5m", "e_5m")
oracle("indicator_a", f"SELECT series_id, bar_close, {r('A_macd')}, {r('A_signal')}, {r('A_hist')}, {r('A_hist_slope')}, A_macd_sign, A_hist_sign, A_macd_zero_cross, A_hist_zero_cross, A_state FROM f_5m", "f_5m")
oracle("indicator_b", f"SELECT series_id, bar_close, {r('B_gap')}, CASE WHEN B_roc_invalid = 0 THEN round(B_roc, 3) + 0.0 END AS B_roc, B_roc_invalid, {r('B_gap_acc')}, B_zroc_extreme, B_state FROM f_5m", "f_5m")
oracle("zero_cross_events", "SELECT series_id, bar_close, A_hist_zero_cross AS direction FROM f_5m WHERE A_hist_zero_cross <> 0", "f_5m")
oracle("quadrant_state", "SELECT series_id, bar_close, A_state FROM f_15m", "f_15m")
oracle("rolling_zscore", f"SELECT series_id, bar_close, {r('B_zroc', digits=4)} FROM f_5m WHERE B_zroc IS NOT NULL", "f_5m")
oracle("roc_invalid_flag", "SELECT series_id, sum(B_roc_invalid)::BIGINT AS n_invalid, count(*) AS n_rows FROM f_5m GROUP BY series_id", "f_5m")
oracle("state_distribution", f"SELECT series_id, A_state, n, {r('n / sum(n) OVER (PARTITION BY series_id)', 'share')} FROM (SELECT series_id, A_state, count(*) AS n FROM f_5m WHERE A_state IS NOT NULL GROUP BY ALL)", "f_5m")
oracle("warmup_drop", f"SELECT series_id, bar_close, (i - 50)::INTEGER AS bar_idx, close FROM (SELECT *, row_number() OVER {W} - 1 AS i FROM b_5m) WHERE i >= 50", "b_5m")
oracle("asof_join_backward", "SELECT a.series_id, a.bar_close, a.close, b.bar_close AS bar_close_1h, b.close AS close_1h FROM b_5m a ASOF LEFT JOIN b_1h b ON a.series_id = b.series_id AND a.bar_close >= b.bar_close", "b_5m", "b_1h")
oracle("master_multi_tf", f"SELECT series_id, bar_close, bar_close_15m, bar_close_1h, bar_close_1d, {r('A_hist')}, {r('A_hist_15m')}, {r('A_hist_1h')}, {r('A_hist_1d')}, A_state, A_state_15m, B_state_1h FROM mm", "mm")
oracle("no_lookahead_violations", "SELECT " + ", ".join(f"count(*) FILTER (bar_close_{tf} > bar_close) AS n_{tf}" for tf in HIGHER) + " FROM mm", "mm")
oracle("extract_tf", f"SELECT series_id, bar_close_1h AS bar_close, {r('close')}, {r('A_hist_1h', 'A_hist')}, A_state_1h AS A_state FROM (SELECT *, row_number() OVER (PARTITION BY series_id, bar_close_1h ORDER BY bar_close) AS n FROM mm) WHERE n = 1", "mm")
oracle("forward_returns", f"SELECT series_id, bar_close, {', '.join(r(f'ret_fwd_{n}') for n in HORIZONS)} FROM (SELECT *, {LEADS} FROM b_5m)", "b_5m")
oracle(
    "triple_barrier",
    f"""SELECT series_id, bar_close, CASE WHEN len(nx) = 24 THEN CASE WHEN up > 0 AND (down = 0 OR up <= down) THEN 1 WHEN down > 0 THEN -1 ELSE 0 END END::INTEGER AS barrier_hit FROM (
    SELECT *, coalesce(list_position(list_transform(nx, lambda c: c >= close * 1.006), true), 0) AS up, coalesce(list_position(list_transform(nx, lambda c: c <= close * 0.994), true), 0) AS down
    FROM (SELECT *, list(close) OVER {rows('1 FOLLOWING', '24 FOLLOWING')} AS nx FROM b_1h))""",
    "b_1h",
)
last20 = rows("19 PRECEDING", "CURRENT ROW")
oracle(
    "regime_label",
    f"""SELECT series_id, bar_close, CASE WHEN n = 20 THEN CASE WHEN v = 0 THEN 'chop' WHEN r2 > 0.5 AND sl > 0 THEN 'trend_up' WHEN r2 > 0.5 AND sl < 0 THEN 'trend_down' ELSE 'chop' END END AS regime FROM (
    SELECT *, count(close) OVER {last20} AS n, var_pop(close) OVER {last20} AS v, regr_slope(close, i) OVER {last20} AS sl, regr_r2(close, i) OVER {last20} AS r2 FROM (SELECT *, (row_number() OVER {W})::DOUBLE AS i FROM b_15m))""",
    "b_15m",
)
oracle("state_conditional_returns", f"SELECT series_id, A_state, count(*) AS n, count(ret_fwd_12) AS n_ret, {r('avg(ret_fwd_12)', 'mean_ret')}, {r('avg((ret_fwd_12 > 0)::INTEGER::DOUBLE)', 'hit_rate')} FROM t WHERE A_state IS NOT NULL GROUP BY ALL", "t")
STAT = f"n, {r('mean_ret', digits=5)}, {r('hit_rate', digits=5)}, {r('t_stat', digits=5)}"
cte("lt", long("t", "series_id, A_state") + " ", "t")
oracle("hac_mean_by_state", f"SELECT series_id, A_state, horizon, n_rows, {STAT} FROM ({hac('(SELECT * FROM lt WHERE A_state IS NOT NULL)', 'series_id, A_state, horizon')})", "lt")
oracle("corr_pearson", " UNION ALL ".join(f"SELECT series_id, '{x}' AS feature, '{y}' AS horizon, {r(pearson(x, y), 'corr')} FROM t GROUP BY series_id" for x in ("A_hist", "A_macd", "B_gap") for y in ("ret_fwd_3", "ret_fwd_12")), "t")
cte("pairs", " UNION ALL ".join(f"SELECT series_id, '{x}' AS feature, '{y}' AS horizon, {x} AS x, {y} AS y FROM t WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for x in ("A_hist", "B_gap") for y in ("ret_fwd_3", "ret_fwd_12")), "t")
oracle(
    "corr_spearman",
    f"""SELECT series_id, feature, horizon, {r(pearson('rx', 'ry'), 'corr')} FROM (SELECT *, rank() OVER (PARTITION BY series_id, feature, horizon ORDER BY x) + (count(*) OVER (PARTITION BY series_id, feature, horizon, x) - 1) / 2 AS rx,
    rank() OVER (PARTITION BY series_id, feature, horizon ORDER BY y) + (count(*) OVER (PARTITION BY series_id, feature, horizon, y) - 1) / 2 AS ry FROM pairs) GROUP BY ALL""",
    "pairs",
)
oracle(
    "decile_returns",
    f"""SELECT series_id, decile::INTEGER AS decile, {r('e[decile]', 'lo', 5)}, {r('e[decile + 1]', 'hi', 5)}, count(*) AS n, {r('avg(ret_fwd_3)', 'mean_ret_fwd_3', 5)}, {r('avg(ret_fwd_12)', 'mean_ret_fwd_12', 5)} FROM (
    SELECT t.*, e, greatest(1, len(list_filter(e, lambda k: k < A_hist))) AS decile FROM t JOIN (SELECT series_id, list_sort(list_distinct(quantile_cont(A_hist, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM t GROUP BY series_id) q USING (series_id)
    WHERE A_hist IS NOT NULL AND len(e) >= 3) GROUP BY series_id, decile, e""",
    "t",
)
cte("xc", f"SELECT series_id, lag::INTEGER AS lag, {pearson('a', 'b')} AS corr FROM (SELECT p.series_id, l.lag, p.A_hist AS a, q.B_gap AS b FROM t p CROSS JOIN (SELECT unnest(range(-20, 21)) AS lag) l LEFT JOIN t q ON q.series_id = p.series_id AND q.bar_idx = p.bar_idx - l.lag) GROUP BY ALL", "t")
oracle("cross_correlation", f"SELECT series_id, lag, {r('corr')} FROM xc", "xc")
oracle("cross_correlation_peak", "SELECT series_id, arg_max(lag, row(abs(corr), -lag)) AS peak_lag FROM xc WHERE corr IS NOT NULL GROUP BY series_id", "xc")
qlags = ", ".join(f"q * lag(q, {k}) OVER {W} AS l{k}" for k in range(1, 13))
qsum = " + ".join(["sum(q * q)"] + [f"{2 * (1 - k / 13)!r} * coalesce(sum(l{k}), 0)" for k in range(1, 13)])
oracle(
    "nested_ols_hac",
    f"""SELECT series_id, n AS n_obs, {r('r0', 'r2_a', 5)}, {r('r1', 'r2_ab', 5)}, {r('r1 - r0', 'delta_r2', 5)}, {r('coef_b', digits=5)}, {r('coef_b / sqrt(v * n / (n - 3))', 't_b', 5)} FROM (
    SELECT series_id, n, coef_b, say * say / (saa * syy) AS r0, 1 - sum(u * u) / syy AS r1, {qsum} AS v FROM (SELECT *, {qlags} FROM (
    SELECT *, u * (saa * b - sab * a) / det AS q FROM (SELECT *, y - (sbb * say - sab * sby) / det * a - (saa * sby - sab * say) / det * b AS u, (saa * sby - sab * say) / det AS coef_b FROM (
    SELECT *, saa * sbb - sab * sab AS det FROM (SELECT series_id, bar_close, y, a, b, count(*) OVER s AS n, sum(a * a) OVER s AS saa, sum(a * b) OVER s AS sab, sum(b * b) OVER s AS sbb, sum(a * y) OVER s AS say, sum(b * y) OVER s AS sby, sum(y * y) OVER s AS syy FROM (
    SELECT series_id, bar_close, ret_fwd_12 - avg(ret_fwd_12) OVER s AS y, A_hist - avg(A_hist) OVER s AS a, B_gap - avg(B_gap) OVER s AS b FROM t WHERE ret_fwd_12 IS NOT NULL AND A_hist IS NOT NULL AND B_gap IS NOT NULL WINDOW s AS (PARTITION BY series_id)) WINDOW s AS (PARTITION BY series_id)))))) GROUP BY series_id, n, coef_b, say, saa, syy) WHERE n >= 30""",
    "t",
)
cte("st", "SELECT unnest(['bull_accel', 'bull_decel', 'bear_decel', 'bear_accel']) AS s")
cte("js", hac("(SELECT series_id, bar_close, A_state AS state_a, B_state AS state_b, ret_fwd_12 AS ret FROM t WHERE A_state IS NOT NULL AND B_state IS NOT NULL)", "series_id, state_a, state_b"), "t")
cte("jm", "SELECT d.*, coalesce(n_rows, 0) AS n, " + ", ".join(f"CASE WHEN n_rows >= 5 THEN {c} END AS {c}" for c in ("mean_ret", "hit_rate", "t_stat")) + " FROM (SELECT DISTINCT series_id, a.s AS state_a, b.s AS state_b FROM t, st a, st b) d LEFT JOIN js USING (series_id, state_a, state_b)", "t", "st", "js")
oracle("joint_state_matrix", f"SELECT series_id, state_a, state_b, {STAT} FROM jm", "jm")
oracle(
    "joint_state_chi2",
    f"""SELECT series_id, {r('sum((n - x) * (n - x) / nullif(x, 0))', 'chi2', 5)}, 9::INTEGER AS dof, {r('avg(mean_ret) FILTER (state_a = state_b)', 'diag_mean', 5)}, {r('avg(mean_ret) FILTER (state_a <> state_b)', 'off_diag_mean', 5)} FROM (
    SELECT *, (sum(n) OVER (PARTITION BY series_id, state_a))::DOUBLE * (sum(n) OVER (PARTITION BY series_id, state_b)) / nullif(sum(n) OVER (PARTITION BY series_id), 0) AS x FROM jm) GROUP BY series_id""",
    "jm",
)
oracle(
    "fdr_bh",
    f"""SELECT o_orderkey, o_orderstatus, {r('p')}, {r('least(1.0, min(raw) OVER (PARTITION BY o_orderstatus ORDER BY p, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))', 'p_adj')} FROM (
    SELECT *, p * count(*) OVER (PARTITION BY o_orderstatus) / row_number() OVER (PARTITION BY o_orderstatus ORDER BY p, o_orderkey) AS raw FROM (SELECT o_orderkey, o_orderstatus, o_totalprice / 1e6 AS p FROM orders))""",
)
cte("pt", f"SELECT * FROM (SELECT *, lag(A_state) OVER {W} AS before FROM t) WHERE before = 'bull_accel' AND A_state = 'bull_decel'", "t")
oracle("peak_transition_events", f"SELECT series_id, bar_close, {r('ret_fwd_3')}, {r('ret_fwd_12')} FROM pt", "pt")
oracle("peak_transition_summary", f"SELECT series_id, count(*) AS n_events, {r('avg(ret_fwd_3)', 'mean_ret_fwd_3', 5)}, {r('avg(ret_fwd_12)', 'mean_ret_fwd_12', 5)}, {r('avg(ret_fwd_3) / nullif(avg(ret_fwd_12), 0)', 'short_vs_long', 5)} FROM pt GROUP BY series_id", "pt")
oracle("aligned_vs_tired", f"""SELECT series_id, bar_close, CASE WHEN A_hist > 0 AND A_hist_slope > 0 THEN 'aligned' ELSE 'tired' END AS "group", {r('ret_fwd_12')} FROM t WHERE A_macd_zero_cross = 1""", "t")
oracle("pullback_split", f"""SELECT series_id, bar_close, CASE WHEN A_macd > 0 THEN 'with_trend' ELSE 'counter_trend' END AS "group", {r('ret_fwd_12')} FROM t WHERE A_hist_zero_cross = 1""", "t")
oracle("zroc_term_structure", f"SELECT * FROM (SELECT series_id, CASE WHEN abs(B_zroc) <= 0.5 THEN 'baseline' WHEN B_zroc > 0.5 AND B_zroc <= 2 THEN 'moderate' WHEN B_zroc > 2 THEN 'extreme_bull' WHEN B_zroc < -2 THEN 'extreme_bear' END AS bucket, {r('avg(ret_fwd_3)', 'mean_ret_fwd_3', 5)}, {r('avg(ret_fwd_12)', 'mean_ret_fwd_12', 5)} FROM t GROUP BY 1, 2) WHERE bucket IS NOT NULL", "t")
oracle(
    "early_turn_runs",
    f"""SELECT series_id, bar_close, streak, confirmed FROM (SELECT *, sum(ok) OVER (PARTITION BY series_id, island ORDER BY bar_close ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM (SELECT *, sum(1 - ok) OVER (PARTITION BY series_id ORDER BY bar_close ROWS UNBOUNDED PRECEDING) AS island,
    coalesce(max((B_gap >= 0)::INTEGER) OVER {rows('1 FOLLOWING', '20 FOLLOWING')}, 0) = 1 AS confirmed FROM (SELECT *, coalesce(B_gap < 0 AND B_gap_acc > 0, false)::INTEGER AS ok FROM t))) WHERE streak >= 3""",
    "t",
)
cte("tc", f"SELECT series_id, bar_idx AS flip_idx, seen IS NOT NULL AS confirmed, (seen - bar_idx)::DOUBLE AS bars_to_confirm FROM (SELECT *, min(CASE WHEN B_gap_acc > 0 THEN bar_idx END) OVER {rows('1 FOLLOWING', '20 FOLLOWING')} AS seen FROM t) WHERE A_hist_zero_cross = 1", "t")
oracle("turn_confirmation", "SELECT * FROM tc", "tc")
oracle("turn_confirmation_summary", f"SELECT series_id, count(*) AS n_flips, count(*) FILTER (confirmed) AS n_confirmed, {r('avg(confirmed::INTEGER::DOUBLE)', 'confirmation_rate')}, {r('median(bars_to_confirm)', 'median_bars')} FROM tc GROUP BY series_id", "tc")
oracle("local_maxima_candidates", f"SELECT series_id, bar_close, close FROM (SELECT *, lag(close) OVER {W} AS b, lead(close) OVER {W} AS n FROM b_5m) WHERE close > b AND close > n", "b_5m")
cte(
    "ce",
    f"""SELECT f.series_id, f.bar_close, sign(f.B_zroc)::INTEGER AS direction, (j - i)::INTEGER AS lag_bars FROM (SELECT series_id, j, min(bar_idx) AS i FROM (
    SELECT *, min(CASE WHEN abs(B_zroc) > 1.5 THEN bar_idx END) OVER {rows('1 FOLLOWING', '10 FOLLOWING')} AS j, quantile_cont(abs(B_gap_norm), 0.1) OVER (PARTITION BY series_id) AS edge FROM f_15m)
    WHERE abs(B_gap_norm) <= edge AND j IS NOT NULL GROUP BY series_id, j) e JOIN f_15m f ON f.series_id = e.series_id AND f.bar_idx = e.j""",
    "f_15m",
)
oracle("compression_expansion", "SELECT * FROM ce", "ce")
cte("t15", f"SELECT *, {LEADS} FROM f_15m", "f_15m")
cte("l15", long("t15", "series_id"), "t15")
oracle(
    "squeeze_event_study",
    f"""SELECT series_id, horizon, n, {r('mean_directional', digits=5)}, {r('mean_abs', digits=5)}, {r('mean_abs_all', digits=5)} FROM (SELECT series_id, horizon, count(ret) AS n, avg(direction * ret) AS mean_directional, avg(abs(ret)) AS mean_abs FROM ce JOIN l15 USING (series_id, bar_close) GROUP BY ALL)
    JOIN (SELECT series_id, horizon, avg(abs(ret)) AS mean_abs_all FROM l15 GROUP BY ALL) USING (series_id, horizon)""",
    "ce", "l15",
)
cte("pk", """SELECT *, g AS "group" FROM (SELECT *, unnest(['unconditional', A_state_1h]) AS g FROM mm WHERE A_state = 'bull_accel') WHERE g IS NOT NULL""", "mm")
cte("lp", long("pk", 'series_id, "group"'), "pk")
oracle(
    "stratify_htf_state",
    f"""SELECT series_id, "group", horizon, coalesce(n_5m, 0) AS n_5m, coalesce(n_htf, 0) AS n_htf, {', '.join(r(f'CASE WHEN n_5m >= 5 THEN {c} END', c, 5) for c in ('mean_ret', 'hit_rate', 't_stat'))} FROM (SELECT DISTINCT series_id, s AS "group", h AS horizon FROM pk, (SELECT s FROM st UNION ALL SELECT 'unconditional'), (SELECT unnest(['ret_fwd_3', 'ret_fwd_12']) AS h))
    LEFT JOIN (SELECT series_id, "group", count(*) AS n_5m, count(DISTINCT bar_close_1h) AS n_htf FROM pk GROUP BY ALL) USING (series_id, "group") LEFT JOIN ({hac('lp', 'series_id, "group", horizon')}) USING (series_id, "group", horizon)""",
    "pk", "lp", "st",
)
cte(
    "ft",
    """SELECT l.series_id, l.bar_close, l.direction, count(m) > 0 AS followed_through, min(m)::DOUBLE AS lag_bars FROM (SELECT series_id, bar_close, A_hist_zero_cross AS direction FROM f_15m WHERE A_hist_zero_cross <> 0) l
    LEFT JOIN LATERAL (SELECT CASE WHEN z = l.direction THEN k END AS m FROM (SELECT A_hist_zero_cross AS z, row_number() OVER (ORDER BY h.bar_close) AS k FROM f_1h h WHERE h.series_id = l.series_id AND h.bar_close > l.bar_close) WHERE k <= 4) ON true GROUP BY ALL""",
    "f_15m", "f_1h",
)
oracle("cross_tf_followthrough", "SELECT * FROM ft", "ft")
oracle("transition_summary", f"SELECT series_id, direction, count(*) AS n_events, {r('avg(followed_through::INTEGER::DOUBLE)', 'p_followthrough')}, {r('median(lag_bars)', 'median_lag_bars')} FROM ft GROUP BY ALL", "ft")
for s in ("score_bull", "score_bull_accel", "score_bear"):
    oracle(s, f"SELECT series_id, bar_close, {s} FROM ms", "ms")
oracle("score_distribution", "SELECT series_id, score_bull, count(*) AS n FROM ms GROUP BY ALL", "ms")
for s in ("bull", "bear"):
    cte(f"l{s}", long("ms", f"series_id, score_{s} AS score"), "ms")
    cte(f"s{s}", hac(f"l{s}", "series_id, score, horizon", least_mean=5), f"l{s}")
oracle("score_bucketed_returns", f"SELECT series_id, score, horizon, {STAT} FROM sbull", "sbull")
oracle("bull_bear_asymmetry", f"SELECT series_id, score, horizon, a.n AS n_bull, {r('a.mean_ret', 'mean_bull', 5)}, b.n AS n_bear, {r('b.mean_ret', 'mean_bear', 5)}, {r('abs(a.mean_ret) - abs(b.mean_ret)', 'abs_diff', 5)} FROM sbull a JOIN sbear b USING (series_id, score, horizon)", "sbull", "sbear")
NAMES = ("A_5m", "B_5m", "A_15m", "B_15m", "A_1h", "B_1h", "A_1d", "B_1d")
oracle("rule_enumeration", "SELECT i::INTEGER AS rule_id, " + ", ".join(f"((i >> {k}) & 1)::INTEGER AS {f}" for k, f in enumerate(NAMES)) + " FROM range(256) x(i)")
oracle("rule_active_flags", "SELECT i::INTEGER AS rule_id, concat_ws(', ', " + ", ".join(f"CASE WHEN (i >> {k}) & 1 = 1 THEN '{f}' END" for k, f in enumerate(NAMES)) + ") AS flags FROM range(256) x(i)")


def evaluated(source: str, keys: str = "series_id") -> str:
    inner = hac(f"(SELECT *, ret_fwd_12 AS ret FROM {source})", f"{keys}, rule_id", least_mean=5)
    return f"SELECT {keys}, rule_id, coalesce(n, 0) AS n, coalesce(n, 0) / total AS frequency, mean_ret, hit_rate, t_stat FROM (SELECT {keys}, count(*) AS total, unnest(range(256))::INTEGER AS rule_id FROM {source} GROUP BY {keys}) LEFT JOIN ({inner}) USING ({keys}, rule_id)"


cte("ev", evaluated("ms"), "ms")
oracle("rule_evaluation_256", f"SELECT series_id, rule_id, n, {r('frequency', digits=5)}, {r('mean_ret', digits=5)}, {r('hit_rate', digits=5)}, {r('t_stat', digits=5)} FROM ev", "ev")
cte("rk", "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY composite DESC, rule_id) AS b, row_number() OVER (PARTITION BY series_id ORDER BY composite, rule_id) AS w FROM (SELECT *, frequency * abs(mean_ret) * (hit_rate - 0.5) AS composite FROM ev) WHERE composite IS NOT NULL", "ev")
oracle("rule_topk", " UNION ALL ".join(f"SELECT series_id, rule_id, n, {r('mean_ret', digits=5)}, {r('hit_rate', digits=5)}, {r('composite', digits=5)}, '{side}' AS side, {c}::INTEGER AS place FROM rk WHERE {c} <= 5" for side, c in (("top", "b"), ("bottom", "w"))), "rk")
oracle(
    "rule_hamming_dedupe",
    """SELECT series_id, (unnest(range(len(kept))))::INTEGER AS place, unnest(kept)::INTEGER AS rule_id FROM (SELECT series_id, list_reduce(list([rule_id] ORDER BY b), lambda a, x: CASE WHEN len(list_filter(a, lambda k: bit_count(xor(k, x[1])) < 2)) = 0 THEN list_concat(a, x) ELSE a END) AS kept FROM rk WHERE b <= 20 GROUP BY series_id)""",
    "rk",
)
cte("wk", "SELECT *, CASE WHEN ret_fwd_12 IS NOT NULL THEN sign(ret_fwd_12) = 1 END AS worked FROM ms", "ms")
oracle("worked_failed_split", f"SELECT series_id, count(*) FILTER (rule_id = 255 AND worked) AS n_worked, count(*) FILTER (rule_id = 255 AND NOT worked) AS n_failed, {r('avg(worked::INTEGER::DOUBLE) FILTER (rule_id = 255)', 'hit_rule')}, {r('avg(worked::INTEGER::DOUBLE)', 'hit_all')} FROM wk GROUP BY series_id", "wk")
cte("wl", " UNION ALL ".join(f"SELECT series_id, worked, '{c}' AS feature, {c} AS x FROM wk WHERE A_state = 'bull_accel' AND worked IS NOT NULL AND {c} IS NOT NULL" for c in ("A_hist", "A_macd", "B_gap", "A_hist_1h", "B_gap_1h")), "wk")
cte(
    "md",
    """SELECT series_id, feature, n_worked, n_failed, m1 AS mean_worked, m0 AS mean_failed, (m1 - m0) / nullif(sqrt(((a - 1) * v1 + (b - 1) * v0) / nullif(a + b - 2, 0)), 0) AS cohens_d, (m1 - m0) / nullif(sqrt(v1 / nullif(a, 0) + v0 / nullif(b, 0)), 0) AS t_stat FROM (
    SELECT series_id, feature, count(*) FILTER (worked) AS a, count(*) FILTER (NOT worked) AS b, avg(x) FILTER (worked) AS m1, avg(x) FILTER (NOT worked) AS m0, var_samp(x) FILTER (worked) AS v1, var_samp(x) FILTER (NOT worked) AS v0 FROM wl GROUP BY ALL)
    JOIN (SELECT series_id, count(*) FILTER (worked) AS n_worked, count(*) FILTER (NOT worked) AS n_failed FROM wk WHERE A_state = 'bull_accel' AND worked IS NOT NULL GROUP BY ALL) USING (series_id)""",
    "wl", "wk",
)
oracle("feature_mean_diff", "SELECT series_id, feature, n_worked, n_failed, " + ", ".join(r(c, digits=5) for c in ("mean_worked", "mean_failed", "cohens_d", "t_stat")) + " FROM md", "md")
oracle("propose_filters", f"SELECT series_id, feature, {r('cohens_d', digits=5)}, {r('(mean_worked + mean_failed) / 2', 'midpoint', 5)}, CASE WHEN cohens_d > 0 THEN 'above' ELSE 'below' END AS direction FROM md WHERE abs(cohens_d) > 0.05", "md")
cte("ba", "SELECT series_id, bar_close, 'before' AS stage, ret_fwd_12 AS ret FROM mm WHERE A_state = 'bull_accel' UNION ALL SELECT series_id, bar_close, 'after', ret_fwd_12 FROM mm WHERE A_state = 'bull_accel' AND A_hist_1h > 0", "mm")
oracle("filter_before_after", f"SELECT series_id, stage, {STAT}, {r('n_rows / max(n_rows) OVER (PARTITION BY series_id)', 'frequency', 5)} FROM ({hac('ba', 'series_id, stage', least_mean=5)})", "ba")
oracle("walk_forward_split", """SELECT series_id, CASE WHEN day(bar_close) <= 18 THEN 'discovery' WHEN day(bar_close) <= 24 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, min(bar_close) AS "first", max(bar_close) AS "last" FROM t GROUP BY 1, 2""", "t")
for s, cond in (("in", "<= 18"), ("val", "BETWEEN 19 AND 24"), ("test", "> 24")):
    cte(f"m{s}", f"SELECT * FROM ms WHERE day(bar_close) {cond}", "ms")
    cte(f"e{s}", evaluated(f"m{s}"), f"m{s}")
cte(
    "oc",
    """SELECT series_id, rule_id, a.n AS n_in, a.mean_ret AS mean_in, b.n AS n_val, b.mean_ret AS mean_val, c.n AS n_test, c.mean_ret AS mean_test, sign(b.mean_ret) IS DISTINCT FROM sign(a.mean_ret) AS collapsed_val, sign(c.mean_ret) IS DISTINCT FROM sign(a.mean_ret) AS collapsed_test
    FROM ein a LEFT JOIN eval b USING (series_id, rule_id) LEFT JOIN etest c USING (series_id, rule_id)""",
    "ein", "eval", "etest",
)
oracle("oos_comparison", f"SELECT series_id, rule_id, n_in, {r('mean_in', digits=5)}, n_val, {r('mean_val', digits=5)}, n_test, {r('mean_test', digits=5)}, collapsed_val, collapsed_test FROM oc", "oc")
cte("mp", "SELECT *, ((day(bar_close) - 1) // 10)::INTEGER AS period FROM ms", "ms")
cte("ep", evaluated("mp", "series_id, period"), "mp")
cte("sb", "SELECT ep.series_id, ep.rule_id, count(*) AS n_periods, count(*) FILTER (ep.n >= 5 AND sign(ep.mean_ret) = sign(ev.mean_ret)) AS n_consistent, count(*) FILTER (ep.n >= 5 AND sign(ep.mean_ret) = sign(ev.mean_ret)) <= 1 AS single_period FROM ep JOIN ev ON ep.series_id = ev.series_id AND ep.rule_id = ev.rule_id GROUP BY ALL", "ep", "ev")
oracle("rule_year_stability", "SELECT * FROM sb", "sb")
cte("td", "SELECT series_id, rule_id, count(*) AS n, avg(ret_fwd_12) AS mean_ret, avg(usual) AS baseline, avg((bar_in_session <= 12)::INTEGER::DOUBLE) AS first_hour_share FROM (SELECT *, avg(ret_fwd_12) OVER (PARTITION BY series_id, bar_in_session) AS usual FROM ms WHERE ret_fwd_12 IS NOT NULL) GROUP BY ALL", "ms")
oracle("time_of_day_baseline", "SELECT series_id, rule_id, n, " + ", ".join(r(c, digits=5) for c in ("mean_ret", "baseline", "first_hour_share")) + f", {r('mean_ret - baseline', 'excess', 5)} FROM td", "td")
oracle(
    "rule_verdict",
    """SELECT series_id, rule_id, collapsed_oos, single_period, NOT kept AS tod_explained, NOT collapsed_oos AND NOT single_period AND kept AS survives FROM (SELECT series_id, rule_id, collapsed_val OR collapsed_test AS collapsed_oos, coalesce(single_period, true) AS single_period,
    coalesce(sign(td.mean_ret - baseline) = sign(mean_in) AND abs(td.mean_ret - baseline) >= 0.25 * abs(mean_in), false) AS kept FROM oc LEFT JOIN sb USING (series_id, rule_id) LEFT JOIN td USING (series_id, rule_id))""",
    "oc", "sb", "td",
)
code = lambda c: f"CASE {c} WHEN 'bull_accel' THEN 2.0 WHEN 'bull_decel' THEN 1.0 WHEN 'bear_decel' THEN -1.0 WHEN 'bear_accel' THEN -2.0 ELSE 0.0 END::DOUBLE"
oracle("ml_feature_matrix", f"SELECT series_id, bar_close, bar_in_session::DOUBLE AS bar_in_session, {r('A_hist')}, {code('A_state')} AS A_state, {code('B_state_1h')} AS B_state_1h, A_hist_zero_cross_15m::DOUBLE AS A_hist_zero_cross_15m, (ret_fwd_12 > 0)::INTEGER AS y FROM mm WHERE ret_fwd_12 IS NOT NULL", "mm")
oracle("class_balance", f"SELECT series_id, count(*) AS n, count(*) FILTER (ret_fwd_12 > 0) AS n_pos, {r('avg((ret_fwd_12 > 0)::INTEGER::DOUBLE)', 'share_pos')} FROM t WHERE ret_fwd_12 IS NOT NULL GROUP BY series_id", "t")
oracle(
    "roc_auc",
    f"""SELECT series_id, {r('(s - p * (p + 1) / 2) / (p * q)', 'auc')}, p AS n_pos, q AS n_neg FROM (SELECT series_id, sum(k) FILTER (y) AS s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q FROM (
    SELECT series_id, ret_fwd_12 > 0 AS y, rank() OVER (PARTITION BY series_id ORDER BY A_hist) + (count(*) OVER (PARTITION BY series_id, A_hist) - 1) / 2 AS k FROM t WHERE ret_fwd_12 IS NOT NULL) GROUP BY series_id)""",
    "t",
)
oracle("early_turn_summary", f"SELECT series_id, count(*) AS n_events, count(*) FILTER (confirmed) AS n_confirmed, {r('avg((NOT confirmed)::INTEGER::DOUBLE)', 'false_start_rate')} FROM ({ORACLES['early_turn_runs']}) GROUP BY series_id")
MEANS = f"count(*) AS n, {r('avg(ret_fwd_3)', 'mean_ret_fwd_3', 5)}, {r('avg(ret_fwd_12)', 'mean_ret_fwd_12', 5)}"
oracle("aligned_vs_tired_means", f"""SELECT series_id, CASE WHEN A_hist > 0 AND A_hist_slope > 0 THEN 'aligned' ELSE 'tired' END AS "group", {MEANS} FROM t WHERE A_macd_zero_cross = 1 GROUP BY 1, 2""", "t")
oracle("pullback_means", f"""SELECT series_id, CASE WHEN A_macd > 0 THEN 'with_trend' ELSE 'counter_trend' END AS "group", {MEANS} FROM t WHERE A_hist_zero_cross = 1 GROUP BY 1, 2""", "t")
cte("lmm", long("mm", "series_id"), "mm")
cte("cf", "SELECT ce.series_id, ce.direction, f.bar_close FROM ce JOIN (SELECT series_id, bar_close_15m, min(bar_close) AS bar_close FROM mm GROUP BY ALL) f ON f.series_id = ce.series_id AND f.bar_close_15m = ce.bar_close", "ce", "mm")
oracle(
    "squeeze_on_master",
    f"""SELECT series_id, horizon, n, {r('mean_directional', digits=5)}, {r('mean_abs', digits=5)}, {r('mean_abs_all', digits=5)} FROM (SELECT series_id, horizon, count(ret) AS n, avg(direction * ret) AS mean_directional, avg(abs(ret)) AS mean_abs FROM cf JOIN lmm USING (series_id, bar_close) GROUP BY ALL)
    JOIN (SELECT series_id, horizon, avg(abs(ret)) AS mean_abs_all FROM lmm GROUP BY ALL) USING (series_id, horizon)""",
    "cf", "lmm",
)
oracle(
    "asymmetry_summary",
    f"""SELECT series_id, horizon, {r('avg(d)', 'mean_diff', 5)}, count(*) FILTER (d > 0) AS n_bull_larger, count(*) FILTER (d < 0) AS n_bear_larger FROM (
    SELECT series_id, horizon, abs(a.mean_ret) - abs(b.mean_ret) AS d FROM sbull a JOIN sbear b USING (series_id, score, horizon)) GROUP BY ALL""",
    "sbull", "sbear",
)
oracle(
    "score_monotonicity",
    f"""SELECT series_id, horizon, {r(pearson('rx', 'ry'), 'corr', 5)} FROM (SELECT *, rank() OVER (PARTITION BY series_id, horizon ORDER BY score)::DOUBLE AS rx, rank() OVER (PARTITION BY series_id, horizon ORDER BY mean_ret) + (count(*) OVER (PARTITION BY series_id, horizon, mean_ret) - 1) / 2 AS ry
    FROM sbull WHERE mean_ret IS NOT NULL) GROUP BY ALL""",
    "sbull",
)
oracle("score_returns_wide", "SELECT series_id, score, " + ", ".join(r(f"max(mean_ret) FILTER (horizon = '{h}')", h, 5) for h in ("ret_fwd_3", "ret_fwd_12")) + " FROM sbull GROUP BY series_id, score", "sbull")
oracle("joint_state_wide", "SELECT series_id, state_a, " + ", ".join(f"max(n) FILTER (state_b = '{s}') AS {s}" for s in ("bull_accel", "bull_decel", "bear_decel", "bear_accel")) + " FROM jm GROUP BY series_id, state_a", "jm")
oracle("carried_rules", f"SELECT series_id, (list_position([255, 0, 151, 31], rule_id) - 1)::INTEGER AS place, rule_id, n, {r('mean_ret', digits=5)} FROM ev WHERE rule_id IN (255, 0, 151, 31)", "ev")
