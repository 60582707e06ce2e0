"""Registered queries vs. their DuckDB SQL on the smoke tables (sf0.001)."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tests.conftest import SMOKE

import __spark_entry__ as entry_mod  # noqa: E402

FAST = ["input_profile", "readings_enriched_counts", "agg_month_peaks", "agg_hour_mean", "agg_median_quantile",
        "usage_groups", "risk_set_never", "profile_summary", "profile_calendar_multi", "knn_blocked", "knn_missing",
        "balance_by_cohort", "effect_group", "pretrend", "att_cohort", "pair_effect_hist", "panel_weighted",
        "segment_heatmap_mean", "plan_cumulative", "peak_box", "validation_full", "pretrend_pairs"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    out = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)]
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SMOKE):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SMOKE}/{f}')")
    return c


@pytest.fixture(scope="module")
def sqls():
    return entry_mod.oracle_sql()


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert "top3_mean_consumption" in df.columns


def test_every_query_has_callable():
    q = entry_mod.queries()
    assert len(q) >= 80
    assert set(entry_mod.oracle_sql()) <= set(q)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, sqls, name):
    sdf = entry_mod.queries()[name](spark, SMOKE)
    pdf = pd.DataFrame([r.asDict() for r in sdf.collect()], columns=sdf.columns)
    odf = con.execute(sqls[name]).fetchdf()
    c1, r1 = _rows(pdf)
    c2, r2 = _rows(odf)
    assert c1 == c2
    assert r1 == r2
