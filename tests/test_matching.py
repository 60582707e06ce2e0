"""R, F, N, B operators: hazards H1, H5, H8–H10, H14 and brute-force equivalence."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from kwhlens.operators import balance as B
from kwhlens.operators import matching as N
from kwhlens.operators import panel as R
from kwhlens.operators import profiles as Fp

BASE = "id string, month date, adoption_month date, top3_mean_consumption double, mean_consumption double, " \
       "variance_consumption double, total_consumption double"


def d(s):
    return dt.date.fromisoformat(s)


def base_frame(spark, rows):
    return spark.createDataFrame(rows, BASE)


def panel_rows(n_units=30, seed=3):
    rnd = random.Random(seed)
    starts = [d("2023-03-01"), d("2023-06-15"), None, None]
    rows = []
    for i in range(n_units):
        adopt = starts[i % len(starts)]
        for m in range(30):
            month = dt.date(2021 + (m // 12), m % 12 + 1, 1)
            if rnd.random() < 0.1:
                continue
            y = None if rnd.random() < 0.05 else rnd.uniform(1, 50)
            rows.append((str(i), month, adopt, y, rnd.uniform(1, 10), rnd.uniform(0, 5), rnd.uniform(100, 900)))
    return rows


def test_risk_set_equals_range_join(spark):
    base = base_frame(spark, panel_rows())
    for ctype in ("never_treated", "risk_set"):
        got = R.build_risk_set_rows(base, 12, control_type=ctype)
        ti = base.select(F.col("adoption_month").alias("Ti")).where("Ti IS NOT NULL").distinct()
        st = base.groupBy("id").agg(F.min("adoption_month").alias("st"))
        rule = "(st = Ti OR st IS NULL)" if ctype == "never_treated" else "(st = Ti OR st IS NULL OR st > Ti)"
        brute = (base.join(st, "id").crossJoin(ti)
                 .where(f"month < Ti AND month >= add_months(Ti, -12) AND {rule}")
                 .select("id", "Ti", F.col("st").alias("adoption_month"),
                         F.when(F.col("st") == F.col("Ti"), "treated").otherwise("control").alias("group"),
                         "month", "top3_mean_consumption", "mean_consumption", "variance_consumption",
                         "total_consumption"))
        assert got.exceptAll(brute).count() == 0 and brute.exceptAll(got).count() == 0


def test_mid_month_cohort_includes_adoption_month(spark):
    rows = [("a", d("2023-06-01"), d("2023-06-15"), 1.0, 1.0, 1.0, 1.0),
            ("a", d("2023-05-01"), d("2023-06-15"), 2.0, 1.0, 1.0, 1.0),
            ("c", d("2023-06-01"), None, 3.0, 1.0, 1.0, 1.0)]
    rs = R.build_risk_set_rows(base_frame(spark, rows), 12).collect()
    # H5: June (first of month) is before the mid-month cohort date
    assert sorted((r.id, r.month.month, r.group) for r in rs) == [("a", 5, "treated"), ("a", 6, "treated"),
                                                                  ("c", 6, "control")]


def test_control_type_validation(spark):
    with pytest.raises(ValueError):
        R.build_risk_set_rows(base_frame(spark, panel_rows(4)), 12, control_type="bogus")


def test_empty_cohorts_keep_schema(spark):
    rows = [("c", d("2023-06-01"), None, 3.0, 1.0, 1.0, 1.0)]
    rs = R.build_risk_set_rows(base_frame(spark, rows), 12)
    assert rs.count() == 0 and "top3_mean_consumption" in rs.columns


def test_trend_uses_all_rows(spark):
    rr = spark.createDataFrame(
        [(d("2023-03-01"), "u", None, "control", d("2022-01-01"), 1.0, 0.0, 0.0, 0.0),
         (d("2023-03-01"), "u", None, "control", d("2022-02-01"), None, 0.0, 0.0, 0.0),
         (d("2023-03-01"), "u", None, "control", d("2022-03-01"), 5.0, 0.0, 0.0, 0.0)],
        "Ti date, id string, adoption_month date, group string, month date, top3_mean_consumption double, "
        "mean_consumption double, variance_consumption double, total_consumption double")
    p = Fp.build_summary_profiles(rr, list(Fp.SUMMARY_BASE)).first()
    # H9: n = 3 and Σx = 6 count the month with a missing peak
    n, sx, sy, sxy, sx2 = 3, 6.0, 6.0, 1.0 + 15.0, 14.0
    assert p.trend == pytest.approx((n * sxy - sx * sy) / (n * sx2 - sx * sx))
    assert p.peak_volatility is None  # no two consecutive non-missing rows
    lag = Fp.build_lag_profiles(rr, 3).first()
    assert (lag.peak_lag_1, lag.peak_lag_2, lag.peak_lag_3, lag.valid_dim) == (5.0, None, 1.0, 2)


def test_calendar_multi_price_one_row_per_unit(spark):
    rr = spark.createDataFrame(
        [(d("2023-03-01"), "c", None, "control", d("2023-01-01"), 1.0, 2.0),
         (d("2023-03-01"), "c", None, "control", d("2022-11-01"), 3.0, 4.0)],
        "Ti date, id string, adoption_month date, group string, month date, "
        "top3_mean_consumption_all double, top3_mean_consumption_high double")
    prof = Fp.build_calendar_profiles(rr, [1, 11], 1)
    assert prof.count() == 1  # H1
    r = prof.first()
    assert (r.all_jan_1, r.high_jan_1, r.all_nov_1, r.high_nov_1) == (1.0, 2.0, 3.0, 4.0)


def z_profiles(spark, n=40, seed=1, with_nulls=False, feats=("peak_mean", "peak_sd", "trend")):
    rnd = random.Random(seed)
    rows = []
    for ti in (d("2023-03-01"), d("2023-06-15")):
        for i in range(n):
            grp = "treated" if i % 4 == 0 else "control"
            vals = []
            for f in feats:
                v = rnd.choice([0.0, rnd.uniform(-30, 30), rnd.uniform(1, 60)])
                if with_nulls and rnd.random() < 0.2:
                    v = None
                vals.append(v)
            rows.append((ti, f"{ti}_{i}", ti if grp == "treated" else None, grp, *vals))
    schema = "Ti date, id string, adoption_month date, group string, " + ", ".join(f"{f} double" for f in feats)
    prof = spark.createDataFrame(rows, schema)
    return Fp.standardize_by_control(prof, list(feats)), list(feats)


def brute_topk(pz, feats, k, thr=None, block=None, missing=False, min_valid=None):
    rows = pz.collect()
    out = []
    for t in [r for r in rows if r.group == "treated"]:
        cands = []
        for c in [r for r in rows if r.group == "control" and r.Ti == t.Ti and r.id != t.id]:
            if block is not None:
                tv, cv = t[block], c[block]
                if tv is None or cv is None or not abs(cv - tv) <= thr * abs(tv):
                    continue
            if missing:
                pairs = [(t[f + "_z"], c[f + "_z"]) for f in feats if t[f + "_z"] is not None and c[f + "_z"] is not None]
                if len(pairs) < min_valid:
                    continue
                dist = math.sqrt(sum((a - b) ** 2 for a, b in pairs) / len(pairs))
            else:
                if any(t[f + "_z"] is None or c[f + "_z"] is None for f in feats):
                    continue
                dist = math.sqrt(sum((t[f + "_z"] - c[f + "_z"]) ** 2 for f in feats))
            cands.append((dist, c.id, dist))
        cands.sort()
        out += [(t.id, c_id, t.Ti, i + 1) for i, (_, c_id, _) in enumerate(cands[:k])]
    return sorted(out)


@pytest.mark.parametrize("thr", [0.3, 0.05, 0.9, 1.5])
def test_blocked_knn_equals_brute_force(spark, thr):
    pz, feats = z_profiles(spark)
    got = N.match_topk(pz, feats, 3, thr, True, "peak_mean", rows_per_salt=7)
    g = sorted((r.treated_id, r.control_id, r.adoption_month, r.match_rank) for r in got.collect())
    assert g == brute_topk(pz, feats, 3, thr, "peak_mean")


def test_missing_aware_knn_equals_brute_force(spark):
    pz, feats = z_profiles(spark, with_nulls=True, feats=tuple(f"f{i}" for i in range(7)))
    got = N.match_topk_allow_missing(pz, feats, 4, rows_per_salt=5)
    g = sorted((r.treated_id, r.control_id, r.adoption_month, r.match_rank) for r in got.collect())
    assert g == brute_topk(pz, feats, 4, missing=True, min_valid=N.default_min_valid_dim(len(feats)))
    assert N.default_min_valid_dim(7) == 2 and N.default_min_valid_dim(12) == 3  # H14: 30 %, at least 2


def test_standardized_controls(spark):
    pz, feats = z_profiles(spark)
    st = pz.where("group = 'control'").groupBy("Ti").agg(F.avg("peak_mean_z").alias("m"),
                                                         F.stddev_samp("peak_mean_z").alias("s")).collect()
    for r in st:
        assert abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9


def test_balance_tables(spark):
    pz, feats = z_profiles(spark)
    m = N.match_topk(pz, feats, 2, use_peak_blocking=False)
    mp = N.build_matched_profiles(pz, m)
    pooled = B.balance_table(mp, feats, pool=True).collect()
    assert sorted(r.covariate for r in pooled) == sorted(feats)
    pdf = mp.toPandas()
    for r in pooled:
        t = pdf[pdf.group == "treated"][r.covariate]
        c = pdf[pdf.group == "control"][r.covariate]
        assert r.treated_mean == pytest.approx(t.mean())
        assert r.SMD == pytest.approx((t.mean() - c.mean()) / math.sqrt((t.var() + c.var()) / 2))
    by = B.balance_table(mp, feats, pool=False)
    assert by.count() == 2 * len(feats)
    love = B.love_data(B.balance_table(mp, feats)).collect()
    assert [r.abs_SMD for r in love] == sorted(r.abs_SMD for r in love)
