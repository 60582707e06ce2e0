"""Registered queries for panels, risk sets, profiles, matching and balance (R, F, N, B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kwhlens.operators import balance as B
from kwhlens.operators import matching as N
from kwhlens.operators import panel as R
from kwhlens.operators import profiles as Fp
from kwhlens.plans import oracle as O
from kwhlens.plans import oracle_matching as OM
from kwhlens.plans import pipelines as L
from kwhlens.plans.registry import REGISTRY, month_result, register

SUMMARY_L1 = ["peak_mean", "mean_consumption", "peak_sd", "trend"]
CAL_MONTHS = [1, 2, 3, 11, 12]


# ------------------------------------------------------------------ Spark chains
def base(spark, d, prices=("all",), mr=None):
    """The panel of the monthly table, or of ``mr`` where a query reads that table once more."""
    mr = month_result(spark, d) if mr is None else mr
    if len(prices) == 1:
        return R.base_panel(mr, price_value=prices[0])
    return R.base_panel(mr, price_values=list(prices))


def risk(spark, d, L_=12, prices=("all",), control_type="never_treated", match_months=None, mr=None):
    return R.build_risk_set_rows(base(spark, d, prices, mr), L_, match_months=match_months, control_type=control_type)


def summary_z(spark, d, vars_=SUMMARY_L1, prices=("all",)):
    prof = Fp.build_summary_profiles(risk(spark, d, 12, prices), vars_)
    return Fp.standardize_by_control(prof, vars_)


def calendar_z(spark, d, years=2, prices=("all",)):
    rr = risk(spark, d, 12 * years, prices)
    cols = Fp.calendar_feature_names(CAL_MONTHS, years, Fp.detect_price_suffixes(rr.columns))
    return Fp.standardize_by_control(Fp.build_calendar_profiles(rr, CAL_MONTHS, years), cols), cols


# ------------------------------------------------------------------ SQL chains
def sql_base(prices=("all",)):
    mr = O.month_result_ctes("A")
    b = OM.base_single(prices[0]) if len(prices) == 1 else OM.base_wide(prices)
    return mr + "," + b


def sql_risk(L_=12, prices=("all",), control_type="never_treated", match_months=None):
    return sql_base(prices) + "," + OM.risk(L_, control_type, OM.value_cols(list(prices)), match_months)


def sfx(prices):
    return [""] if len(prices) == 1 else sorted(R.price_suffix(p) for p in prices)


def sql_summary_z(vars_=SUMMARY_L1, prices=("all",)):
    return (sql_risk(12, prices) + "," + OM.summary_profile(OM.value_cols(list(prices)), sfx(prices), vars_)
            + "," + OM.standardize(vars_))


def sql_calendar_z(years=2, prices=("all",)):
    cols = Fp.calendar_feature_names(CAL_MONTHS, years, sfx(prices))
    return (sql_risk(12 * years, prices) + "," + OM.calendar_profile(CAL_MONTHS, years, sfx(prices))
            + "," + OM.standardize(cols)), cols


def q(ctes, body):
    return O.with_ctes(ctes, body)


PANEL_D = ["top3_mean_consumption", "mean_consumption", "variance_consumption", "total_consumption"]
WIDE_D = OM.value_cols(["high", "all"])

# ------------------------------------------------------------------ R
register("base_panel_single", "R1,R2", q(sql_base(("high",)), "SELECT * FROM base"))(
    lambda s, d: base(s, d, ("high",)))
register("base_panel_wide", "R3", q(sql_base(("high", "all")), "SELECT * FROM base"))(
    lambda s, d: base(s, d, ("high", "all")))
register("cohorts", "R4", q(sql_base(), "SELECT DISTINCT adoption_month AS Ti FROM base WHERE adoption_month IS NOT NULL"))(
    lambda s, d: R.get_distinct_ti(base(s, d)))
register("user_status", "R5", q(sql_base(), "SELECT id, min(adoption_month) AS adoption_month FROM base GROUP BY id"))(
    lambda s, d: R.get_user_status(base(s, d)))
register("risk_set_never", "R6-R9,R11", q(sql_risk(12), "SELECT * FROM risk"))(lambda s, d: risk(s, d, 12))
register("risk_set_notyet", "R7(risk_set)", q(sql_risk(12, control_type="risk_set"), "SELECT * FROM risk"))(
    lambda s, d: risk(s, d, 12, control_type="risk_set"))
register("risk_set_season", "R10", q(sql_risk(24, match_months=CAL_MONTHS), "SELECT * FROM risk"))(
    lambda s, d: risk(s, d, 24, match_months=CAL_MONTHS))
register("risk_set_sizes", "R12",
         q(sql_risk(12), f'SELECT Ti, {OM.Q}, count(*) AS count FROM risk GROUP BY Ti, {OM.Q}'))(
    lambda s, d: R.risk_set_sizes(risk(s, d, 12)))

# ------------------------------------------------------------------ F
ALL7 = OM.summary_vars_all([""])
register("profile_summary", "F2", q(sql_risk(12) + "," + OM.summary_profile(PANEL_D, [""], ALL7), "SELECT * FROM prof"))(lambda s, d: Fp.build_summary_profiles(risk(s, d, 12), ALL7))
WIDE7 = OM.summary_vars_all(["all", "high"])
register("profile_summary_wide", "F1,F2",
         q(sql_risk(12, ("high", "all")) + "," + OM.summary_profile(WIDE_D, ["all", "high"], WIDE7), "SELECT * FROM prof"))(lambda s, d: Fp.build_summary_profiles(risk(s, d, 12, ("high", "all")), WIDE7))
CAL2 = Fp.calendar_feature_names(CAL_MONTHS, 2, [""])
register("profile_calendar", "F3",
         q(sql_risk(24) + "," + OM.calendar_profile(CAL_MONTHS, 2, [""]), "SELECT * FROM prof"))(
    lambda s, d: Fp.build_calendar_profiles(risk(s, d, 24), CAL_MONTHS, 2))
CALW = Fp.calendar_feature_names(CAL_MONTHS, 1, ["all", "high"])
register("profile_calendar_multi", "F4",
         q(sql_risk(12, ("high", "all")) + "," + OM.calendar_profile(CAL_MONTHS, 1, ["all", "high"]), "SELECT * FROM prof"))(lambda s, d: Fp.build_calendar_profiles(risk(s, d, 12, ("high", "all")), CAL_MONTHS, 1))
LAGS = [f"peak_lag_{i}" for i in range(1, 13)]
register("profile_lags", "F5", q(sql_risk(12) + "," + OM.lag_profile(12, PANEL_D), "SELECT * FROM prof"))(
    lambda s, d: Fp.build_lag_profiles(risk(s, d, 12), 12))
Z_L1 = SUMMARY_L1 + [f"{c}_z" for c in SUMMARY_L1]
register("standardized", "F6", q(sql_summary_z(), "SELECT * FROM pz"))(lambda s, d: summary_z(s, d))

# ------------------------------------------------------------------ N
def l1(s, d, mr=None):
    return L.run_summary_matching(risk(s, d, 12, mr=mr), k_neighbors=5, summary_vars=SUMMARY_L1)


register("knn_blocked", "N1,N2,L1",
         q(sql_summary_z() + "," + OM.knn_blocked(SUMMARY_L1, 5, 0.3, "peak_mean"), "SELECT * FROM matches"))(lambda s, d: l1(s, d)["matches"])
S4 = L.SUMMARY_4
register("knn_summary4", "N1,N2",
         q(sql_summary_z(S4) + "," + OM.knn_blocked(S4, 5, 0.3, "peak_mean"), "SELECT * FROM matches"))(lambda s, d: N.match_topk(summary_z(s, d, S4), S4, 5, 0.3, True, "peak_mean"))
S4W = [f"{v}_{p}" for p in ("high", "all") for v in S4]
register("knn_summary4_wide", "N1,N2,F1",
         q(sql_summary_z(S4W, ("high", "all")) + "," + OM.knn_blocked(S4W, 5, 0.3, "peak_mean_high"),
           "SELECT * FROM matches"))(lambda s, d: N.match_topk(summary_z(s, d, S4W, ("high", "all")), S4W, 5, 0.3, True,
                                                 "peak_mean_high"))
register("knn_nonblocked", "N1",
         q(sql_summary_z() + "," + OM.knn_blocked(SUMMARY_L1, 3, None, None), "SELECT * FROM matches"))(lambda s, d: N.match_topk(summary_z(s, d), SUMMARY_L1, 3, use_peak_blocking=False))


def _cal_sql(years, k):
    ctes, cols = sql_calendar_z(years)
    return q(ctes + "," + OM.knn_missing(cols, k), "SELECT * FROM matches")


register("knn_missing", "N3,L3", _cal_sql(2, 3))(
    lambda s, d: L.run_calendar_matching(risk(s, d, 24), 2, CAL_MONTHS, k_neighbors=3)["matches"])
register("knn_missing_1year", "N3,L3", _cal_sql(1, 5))(
    lambda s, d: N.match_topk_allow_missing(*calendar_z(s, d, 1), 5))


def _lag_z_sql():
    return sql_risk(12) + "," + OM.lag_profile(12, PANEL_D) + "," + OM.standardize(LAGS)


register("knn_lags", "N3,L2", q(_lag_z_sql() + "," + OM.knn_missing(LAGS, 5), "SELECT * FROM matches"))(
    lambda s, d: L.run_time_series_matching(risk(s, d, 12), 12, 5)["matches"])


register("knn_nonblocked_pivots", "N1", REGISTRY["knn_nonblocked"].sql)(
    lambda s, d: N.match_topk(summary_z(s, d), SUMMARY_L1, 3, use_peak_blocking=False, prune=True))
register("knn_missing_pivots", "N3", REGISTRY["knn_missing_1year"].sql)(
    lambda s, d: N.match_topk_allow_missing(*calendar_z(s, d, 1), 5, prune=True))


def _vdd_sql():
    ctes, cols = sql_calendar_z(2)
    return q(ctes + "," + OM.knn_candidates_missing(cols),
             "SELECT valid_dim, count(*) AS count FROM cand0 GROUP BY valid_dim")


register("valid_dim_distribution", "N4", _vdd_sql())(lambda s, d: N.valid_dim_distribution(*calendar_z(s, d, 2)))


# ------------------------------------------------------------------ N5/N6, B
L1_SQL = sql_summary_z() + "," + OM.knn_blocked(SUMMARY_L1, 5, 0.3, "peak_mean") + "," + OM.matched_profiles(SUMMARY_L1)
register("matched_profiles", "N5,N6", q(L1_SQL, "SELECT * FROM mp"))(
    lambda s, d: l1(s, d)["matched_profiles"])
register("balance_pooled", "B2", q(L1_SQL, OM.balance(SUMMARY_L1, "mp", True)))(
    lambda s, d: l1(s, d)["balance"])
register("balance_by_cohort", "B1", q(L1_SQL, OM.balance(SUMMARY_L1, "mp", False)))(
    lambda s, d: l1(s, d)["balance_by_ti"])
register("balance_before_matching", "B1", q(sql_summary_z(), OM.balance(SUMMARY_L1, "pz", False)))(
    lambda s, d: B.balance_table(summary_z(s, d), SUMMARY_L1, pool=False))
register("love_data", "B3",
         q(L1_SQL + ",bal AS (" + OM.balance(SUMMARY_L1, "mp", True) + ")",
           "SELECT *, abs(SMD) AS abs_SMD, abs(SMD) > 0.1 AS above_threshold FROM bal"))(
    lambda s, d: B.love_data(l1(s, d)["balance"]))


# ------------------------------------------------------------------ V (hold-out balance of the L1 matches)
V_MATCH = SUMMARY_L1
V_EXTRA = [v for v in ALL7 if v not in SUMMARY_L1]
CAL_V = Fp.calendar_feature_names(CAL_MONTHS, 2, [""])


def _validation(s, d, **kw):
    mr = month_result(s, d)
    return B.validation_balance(l1(s, d, mr)["matches"], base(s, d, mr=mr), SUMMARY_L1, **kw)


def _valid_dim(s, d):
    mr = month_result(s, d)
    return B.calendar_valid_dim_distribution(l1(s, d, mr)["matches"], base(s, d, mr=mr))


def _v_sql(part: str) -> str:
    ctes = (sql_summary_z() + "," + OM.knn_blocked(SUMMARY_L1, 5, 0.3, "peak_mean") + "," + OM.matched_ids_cte()
            + "," + OM.validation_rows(24, 12, PANEL_D, "vr_sum") + "," + OM.validation_rows(24, 0, PANEL_D, "vr_cal")
            + "," + OM.summary_profile(PANEL_D, [""], ALL7, src="vr_sum", name="vprof")
            + "," + OM.calendar_profile(CAL_MONTHS, 2, [""], src="vr_cal", name="vcal"))
    bodies = {
        "matching": OM.tagged_balance(V_MATCH, "vprof", "matching", 24, 12),
        "non_matching": OM.tagged_balance(V_EXTRA, "vprof", "non_matching", 24, 12),
        "calendar": OM.tagged_balance(CAL_V, "vcal", "calendar", 24, 0),
    }
    body = "\nUNION ALL\n".join(bodies.values()) if part == "all" else bodies[part]
    return q(ctes, body)


register("validation_match", "V1,V2", _v_sql("matching"))(
    lambda s, d: _validation(s, d, check_calendar=False).where(F.col("check") == "matching"))
register("validation_extra", "V1,V3", _v_sql("non_matching"))(
    lambda s, d: _validation(s, d, check_calendar=False).where(F.col("check") == "non_matching"))
register("validation_calendar", "V1,V4", _v_sql("calendar"))(
    lambda s, d: _validation(s, d).where(F.col("check") == "calendar"))
register("validation_full", "V5", _v_sql("all"))(lambda s, d: _validation(s, d))


def _v_dim_sql() -> str:
    valid = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in CAL_V)
    ctes = (sql_summary_z() + "," + OM.knn_blocked(SUMMARY_L1, 5, 0.3, "peak_mean") + "," + OM.matched_ids_cte()
            + "," + OM.validation_rows(24, 0, PANEL_D, "vr_cal")
            + "," + OM.calendar_profile(CAL_MONTHS, 2, [""], src="vr_cal", name="vcal"))
    return q(ctes, f"SELECT CAST({valid} AS INTEGER) AS valid_dim, count(*) AS count FROM vcal GROUP BY 1")


register("validation_valid_dim", "V4", _v_dim_sql())(_valid_dim)
