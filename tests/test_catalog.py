"""Queries of the catalog against their DuckDB equivalents on small tables."""

from __future__ import annotations

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"
SOME = ["ohlc_bars_5m", "dedupe_keep_first", "resample_1h", "session_gaps", "indicator_a", "asof_join_backward", "state_conditional_returns", "hac_mean_by_state", "fdr_bh", "turn_confirmation_summary", "rule_enumeration", "rule_active_flags", "triple_barrier", "regime_label", "early_turn_summary", "aligned_vs_tired_means", "pullback_means", "squeeze_on_master", "asymmetry_summary", "score_monotonicity", "score_returns_wide", "joint_state_wide", "carried_rules"]


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [list(rel.columns).index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == want


def test_rest_does_without_the_optional_parts():
    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['tidemark.llm'] = sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; assert 'ohlc_bars_5m' in e.queries() and not [k for k in e.queries() if k.startswith('op') or k == 'pipeline'] and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
    assert not [p for p in (root / "tidemark").rglob("*.py") if "llm" not in p.parts and "tidemark.llm" in p.read_text()]
