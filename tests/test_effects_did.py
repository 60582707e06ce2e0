"""M, E, D operators: pandas / NumPy re-derivations and planted effects."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kwhlens.operators import effects as E
from kwhlens.operators import fixed_effects as D
from kwhlens.operators import matched as M


def planted_panel(seed=0, n=60, T=14, effect=2.0, missing=0.15):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        tr = i % 3 == 0
        a_i = rng.normal()
        w = 1.0 if tr else float(rng.uniform(0.2, 1.0))
        for t in range(T):
            if rng.uniform() < missing:
                continue
            d_ = 1 if (tr and t >= 7) else 0
            y = a_i + 0.3 * t + effect * d_ + rng.normal(scale=0.5)
            month = f"{2024 + t // 12}-{t % 12 + 1:02d}"
            rows.append((f"u{i}", f"e{i}", month, w, d_, y, int(tr), t - 7, "2024-08"))
    return pd.DataFrame(rows, columns=["aID", "entity_id", "month_id", "match_weight", "D", "y", "treatment",
                                       "event_time", "cohort_id"])


def dense_wls_cluster(pdf, regs):
    E_ = pd.get_dummies(pdf.entity_id).to_numpy(float)
    T_ = pd.get_dummies(pdf.month_id).to_numpy(float)[:, 1:]
    Z = np.column_stack([E_, T_])
    w = pdf.match_weight.to_numpy(float)
    sw = np.sqrt(w)

    def resid(v):
        b = np.linalg.lstsq(Z * sw[:, None], v * sw, rcond=None)[0]
        return v - Z @ b

    X = np.column_stack([resid(pdf[r].to_numpy(float)) for r in regs])
    y = resid(pdf.y.to_numpy(float))
    G = X.T @ (w[:, None] * X)
    beta = np.linalg.solve(G, X.T @ (w * y))
    e = y - X @ beta
    S = pd.DataFrame(w[:, None] * X * e[:, None]).groupby(pdf.aID.to_numpy()).sum().to_numpy()
    g, n, k = S.shape[0], len(y), len(regs)
    Gi = np.linalg.inv(G)
    V = (g / (g - 1)) * ((n - 1) / (n - k)) * Gi @ (S.T @ S) @ Gi
    return beta, np.sqrt(np.diag(V))


def test_basic_did_matches_dense(spark):
    pdf = planted_panel()
    res = D.fit_basic_did(spark.createDataFrame(pdf), "y", persist="cache").first()
    beta, se = dense_wls_cluster(pdf, ["D"])
    assert res.coef == pytest.approx(beta[0], rel=1e-9)
    assert res.std_error == pytest.approx(se[0], rel=1e-9)
    assert abs(res.coef - 2.0) < 0.3  # planted effect recovered
    assert res.n_obs == len(pdf) and res.n_entities == pdf.entity_id.nunique()
    assert res.ci_lower == pytest.approx(res.coef - 1.96 * res.std_error)
    assert res.p_value == pytest.approx(math.erfc(abs(res.coef / res.std_error) / math.sqrt(2)), abs=1e-12)


def test_event_study_matches_dense(spark):
    pdf = planted_panel(seed=4)
    window = (-3, 3)
    res = D.fit_event_study(spark.createDataFrame(pdf), "y", window, -1, persist="cache").orderBy("event_time")
    got = res.collect()
    inw = pdf[(pdf.event_time >= window[0]) & (pdf.event_time <= window[1])].copy()
    ks = [k for k in range(window[0], window[1] + 1) if k != -1]
    for k in ks:
        inw[f"ev{k}"] = ((inw.event_time == k) & (inw.treatment == 1)).astype(int)
    regs = [f"ev{k}" for k in ks if inw[f"ev{k}"].sum() > 0 and inw[f"ev{k}"].var() > 0]
    beta, se = dense_wls_cluster(inw, regs)
    assert [r.event_time for r in got] == [int(r[2:]) for r in regs]
    for r, b, s in zip(got, beta, se):
        assert r.coef == pytest.approx(b, rel=1e-8, abs=1e-10)
        assert r.std_error == pytest.approx(s, rel=1e-8)


def test_by_cohort_matches_dense_and_default_size(spark):
    big, small = planted_panel(seed=5, n=90), planted_panel(seed=6, n=20)
    small["cohort_id"], big["aID"] = "2024-09", "b" + big.aID
    big["entity_id"] = "b" + big.entity_id
    n_big, n_small = (p[p.treatment == 1].aID.nunique() for p in (big, small))
    assert n_big >= D.MIN_TREATED > n_small
    df = spark.createDataFrame(pd.concat([big, small]))
    by = dict(group_cols=["cohort_id"], persist="cache")
    got = D.fit_basic_did(df, "y", **by).collect()
    assert [(r.cohort_id, r.n_treated) for r in got] == [("2024-08", n_big)]
    beta, se = dense_wls_cluster(big, ["D"])
    assert (got[0].coef, got[0].std_error) == (pytest.approx(beta[0], rel=1e-9), pytest.approx(se[0], rel=1e-9))
    both = {r.cohort_id: r.coef for r in D.fit_basic_did(df, "y", min_treated=None, **by).collect()}
    assert both["2024-09"] == pytest.approx(dense_wls_cluster(small, ["D"])[0][0], rel=1e-9)
    only = D.fit_basic_did(df, "y", min_treated=None, cohorts=["2024-09"], **by).collect()
    assert [r.cohort_id for r in only] == ["2024-09"] and only[0].coef == pytest.approx(both["2024-09"])


def test_event_study_without_treated_rows_is_refused(spark):
    pdf = planted_panel(seed=8)
    df = spark.createDataFrame(pdf[pdf.treatment == 0])
    with pytest.raises(ValueError, match="no treated row"):
        D.fit_event_study(df, "y", (-3, 3), -1, persist="none")


def test_residuals_orthogonal_to_effects(spark):
    pdf = planted_panel(seed=7)
    df = spark.createDataFrame(pdf).withColumn("_g", F.lit("x"))
    r = D.residualize_twfe(df, ["y"]).toPandas()
    w = r.match_weight
    for key in ("entity_id", "month_id"):
        s = (w * r["y__r"]).groupby(r[key]).sum()
        assert s.abs().max() < 1e-9


def test_identification_of_disconnected_panels(spark):
    """Two sets of entities without a common month: two components, one more free month, and the fit still works."""
    pdf = planted_panel(seed=5)
    other = pdf.copy()
    other["entity_id"] = "z" + other.entity_id.astype(str)
    other["aID"] = "z" + other.aID.astype(str)
    other["month_id"] = "z" + other.month_id.astype(str)
    months = pdf.month_id.nunique()
    one = D.identification(spark.createDataFrame(pdf), "y").first()
    assert (one.n_periods, one.n_components, one.rank_time, one.rank_gram, one.identified) == (months, 1, months - 1, 1, True)
    both = spark.createDataFrame(pd.concat([pdf, other]))
    two = D.identification(both, "y").first()
    assert (two.n_periods, two.n_components, two.rank_time, two.n_entities) == (
        2 * months, 2, 2 * months - 2, 2 * one.n_entities)
    coef = [D.fit_basic_did(x, "y", persist="none").first().coef for x in (spark.createDataFrame(pdf), both)]
    assert coef[0] == pytest.approx(coef[1], rel=1e-9)


def test_identification_sees_what_effects_absorb(spark):
    """D that is constant per entity is taken out by the entity effects."""
    pdf = planted_panel(seed=6)
    pdf["D"] = pdf.treatment
    r = D.identification(spark.createDataFrame(pdf), "y").first()
    assert (r.n_regressors, r.rank_gram, r.identified) == (1, 0, False)
    events = D.identification(spark.createDataFrame(planted_panel(seed=6)), "y", (-3, 3)).first()
    assert events.n_regressors >= events.rank_gram > 0


def test_group_effects_match_pandas(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(40):
        for t in range(-3, 3):
            y = None if rng.uniform() < 0.1 else float(rng.normal(10 + (i % 2) * t, 1))
            rows.append((f"u{i}", "2024-01-01", t, i % 2, y))
    pdf = pd.DataFrame(rows, columns=["aID", "cohort", "event_time", "treatment", "top3_mean_consumption"])
    df = spark.createDataFrame(pdf).withColumn("cohort", F.to_date("cohort"))
    got = {r.event_time: r for r in E.add_confidence_interval(E.compute_effect(df)).collect()}
    for t, g in pdf.groupby("event_time"):
        tr, co = g[g.treatment == 1].top3_mean_consumption, g[g.treatment == 0].top3_mean_consumption
        eff = tr.mean() - co.mean()
        se = math.sqrt(tr.var() / len(tr) + co.var() / len(co))  # n counts missing rows (H12)
        assert got[t].effect == pytest.approx(eff) and got[t].se == pytest.approx(se)
        assert got[t].n_treated == len(tr)
    eff = pd.DataFrame([(t, r.effect) for t, r in got.items()], columns=["event_time", "effect"])
    att = E.average_treatment_effect(spark.createDataFrame(eff)).first()
    post = eff[eff.event_time >= 0].effect
    assert att.ATT == pytest.approx(post.mean()) and att.n_periods == len(post)
    assert att.SE == pytest.approx(post.std() / math.sqrt(len(post)))
    pre = E.pretrend_test(spark.createDataFrame(eff), -3, -1).first()
    assert pre.n_periods == 3 and pre.mean_pre_effect == pytest.approx(eff[eff.event_time < 0].effect.mean())
    one = E.pretrend_test(spark.createDataFrame(eff), -1, -1).first()
    assert one.n_periods == 1 and one.t_stat is None and one.p_value is None


def test_weights_sum_to_treated(spark):
    m = spark.createDataFrame(
        [("t1", "c1", "2024-03-01"), ("t1", "c2", "2024-03-01"), ("t2", "c1", "2024-03-01"),
         ("t3", "c3", "2024-06-15")], "treated_id string, control_id string, adoption_month string"
    ).withColumn("adoption_month", F.to_date("adoption_month"))
    w = M.match_weights(m)
    sums = {r.cohort.month: r.s for r in w.where("treatment = 0").groupBy("cohort").agg(F.sum("match_weight").alias("s")).collect()}
    assert sums == {3: 2.0, 6: 1.0}
    c1 = w.where("aID = 'c1'").first()
    assert c1.match_weight == pytest.approx(1.5)


def test_histogram_numpy_semantics(spark):
    vals = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0, 1.0, 0.3333333]
    df = spark.createDataFrame([(1, v) for v in vals], "k int, x double")
    got = E.histogram(df, "x", ["k"], 4).orderBy("bin").collect()
    counts, edges = np.histogram(vals, bins=4)
    assert [r["count"] for r in got] == counts.tolist()
    assert [r.bin_low for r in got] == pytest.approx(edges[:-1].tolist())
    const = spark.createDataFrame([(1, 2.0), (1, 2.0)], "k int, x double")
    got = E.histogram(const, "x", ["k"], 4).orderBy("bin").collect()
    assert [r["count"] for r in got] == np.histogram([2.0, 2.0], bins=4)[0].tolist()
