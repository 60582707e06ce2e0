"""Registered queries for matched panels, effects and fixed-effects models (M, E, D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kwhlens.functions.stats import Z_975
from kwhlens.operators import effects as E
from kwhlens.operators import fixed_effects as D
from kwhlens.operators import matched as M
from kwhlens.operators.readings import prepare_price_panel
from kwhlens.plans import oracle as O
from kwhlens.plans import oracle_did as OD
from kwhlens.plans import oracle_matching as OM
from kwhlens.plans import pipelines as L
from kwhlens.plans.q_matching import CAL_MONTHS, q, risk, sql_calendar_z, sql_summary_z
from kwhlens.plans.registry import REGISTRY, month_result, register

S4 = L.SUMMARY_4
OUT = "top3_mean_consumption"


# ------------------------------------------------------------------ matches used downstream
def matches_s4(s, d, mr=None):
    """summary_4 on price 'all' (the matches the group-mean inference reads)."""
    return L.run_summary_matching(risk(s, d, 12, mr=mr), k_neighbors=5, summary_vars=S4)["matches"]


def matches_cal_high(s, d, mr=None):
    """calendar2 (2 years, k=5) on price 'high' (the matches the DiD analyses read)."""
    return L.run_calendar_matching(risk(s, d, 24, ("high",), mr=mr), 2, CAL_MONTHS, k_neighbors=5)["matches"]


SQL_M_S4 = sql_summary_z(S4) + "," + OM.knn_blocked(S4, 5, 0.3, "peak_mean")
_cz, _ccols = sql_calendar_z(2, ("high",))
SQL_M_CAL = _cz + "," + OM.knn_missing(_ccols, 5)

MONTH = "CAST(date_trunc('month', {c}) AS DATE)"
EVT = "CAST((year({a})*12 + month({a})) - (year({b})*12 + month({b})) AS INTEGER)"


def sql_m1(matches_sql: str, price: str | None = None) -> str:
    where = f"WHERE mr.price = '{price}'" if price else ""
    return matches_sql + f""",
mm AS (
  SELECT DISTINCT treated_id AS aID, {MONTH.format(c='adoption_month')} AS cohort, 1 AS treatment FROM matches
  UNION ALL
  SELECT control_id AS aID, {MONTH.format(c='adoption_month')} AS cohort, 0 AS treatment FROM matches
),
panel AS (
  SELECT mr.* REPLACE ({MONTH.format(c='mr.TIDPUNKT')} AS TIDPUNKT), mm.cohort, mm.treatment,
         {EVT.format(a='mr.TIDPUNKT', b='mm.cohort')} AS event_time
  FROM month_result mr JOIN mm ON mr.aID = mm.aID {where}
)"""


def sql_m2(matches_sql: str, price: str | None = None) -> str:
    where = f"WHERE price = '{price}'" if price else ""
    return matches_sql + f""",
mr2 AS (SELECT aID, {MONTH.format(c='TIDPUNKT')} AS TIDPUNKT, price, top3_mean_consumption AS y FROM month_result {where}),
mc AS (SELECT treated_id, control_id, {MONTH.format(c='adoption_month')} AS cohort FROM matches),
ctrl AS (
  SELECT mc.treated_id, mc.cohort, r.TIDPUNKT, r.price, avg(r.y) AS matched_control_y, count(r.y) AS n_controls
  FROM mc JOIN mr2 r ON r.aID = mc.control_id GROUP BY 1, 2, 3, 4
),
trt AS (
  SELECT t.treated_id, t.cohort, r.TIDPUNKT, r.price, r.y AS treated_y
  FROM (SELECT DISTINCT treated_id, cohort FROM mc) t JOIN mr2 r ON r.aID = t.treated_id
),
pairs AS (
  SELECT t.treated_id, t.cohort, t.TIDPUNKT, t.treated_y, t.price, c.matched_control_y, c.n_controls,
         {EVT.format(a='t.TIDPUNKT', b='t.cohort')} AS event_time, t.treated_y - c.matched_control_y AS pair_effect
  FROM trt t JOIN ctrl c ON t.treated_id = c.treated_id AND t.cohort = c.cohort AND t.TIDPUNKT = c.TIDPUNKT
                          AND t.price = c.price
)"""


def sql_m3(matches_sql: str, price: str) -> str:
    return matches_sql + f""",
m3 AS (SELECT *, {MONTH.format(c='adoption_month')} AS cohort FROM matches),
per_t AS (SELECT treated_id, cohort, count(control_id) AS n FROM m3 GROUP BY 1, 2),
cw AS (
  SELECT m3.control_id AS aID, m3.cohort, 0 AS treatment, sum(CAST(1 AS DOUBLE) / per_t.n) AS match_weight
  FROM m3 JOIN per_t ON m3.treated_id = per_t.treated_id AND m3.cohort = per_t.cohort GROUP BY 1, 2
),
mw AS (
  SELECT DISTINCT treated_id AS aID, cohort, 1 AS treatment, CAST(1 AS DOUBLE) AS match_weight FROM m3
  UNION ALL SELECT * FROM cw
),
wp0 AS (
  SELECT mr.* REPLACE ({MONTH.format(c='mr.TIDPUNKT')} AS TIDPUNKT), mw.cohort, mw.treatment, mw.match_weight
  FROM (SELECT * FROM month_result WHERE price = '{price}') mr JOIN mw ON mr.aID = mw.aID
),
wp AS (
  SELECT *, strftime(TIDPUNKT, '%Y-%m') AS month_id, strftime(cohort, '%Y-%m') AS cohort_id,
         {EVT.format(a='TIDPUNKT', b='cohort')} AS event_time,
         CAST({EVT.format(a='TIDPUNKT', b='cohort')} >= 0 AS INTEGER) AS post,
         aID || '_cohort_' || strftime(cohort, '%Y-%m') || '_tr_' || CAST(treatment AS VARCHAR) AS entity_id,
         treatment * CAST({EVT.format(a='TIDPUNKT', b='cohort')} >= 0 AS INTEGER) AS D
  FROM wp0
)"""


def sql_effect(src: str, by_cohort: bool) -> str:
    keys = "cohort, event_time" if by_cohort else "event_time"
    means = "" if by_cohort else "mean_treated, mean_control,"
    y = OUT
    return f"""
g AS (
  SELECT {keys},
    avg(CASE WHEN treatment = 1 THEN {y} END) AS mean_treated, avg(CASE WHEN treatment = 0 THEN {y} END) AS mean_control,
    var_samp(CASE WHEN treatment = 1 THEN {y} END) AS vt, var_samp(CASE WHEN treatment = 0 THEN {y} END) AS vc,
    count(CASE WHEN treatment = 1 THEN 1 END) AS n_treated, count(CASE WHEN treatment = 0 THEN 1 END) AS n_control
  FROM {src} WHERE event_time IS NOT NULL GROUP BY {keys}
  HAVING count(CASE WHEN treatment = 1 THEN 1 END) >= 2 AND count(CASE WHEN treatment = 0 THEN 1 END) >= 2
),
e0 AS (SELECT *, mean_treated - mean_control AS effect, sqrt(vt / n_treated + vc / n_control) AS se FROM g),
eff AS (
  SELECT {keys}, {means} effect, se, CASE WHEN se > 0 THEN effect / se END AS t_stat,
         CASE WHEN se > 0 THEN {O.normal_two_sided_p_sql('effect / se')} END AS p_value, n_treated, n_control,
         effect - {Z_975!r} * se AS ci_low, effect + {Z_975!r} * se AS ci_high
  FROM e0
)"""


def sql_pair_effect(by_cohort: bool) -> str:
    keys = "cohort, event_time" if by_cohort else "event_time"
    return f"""
pg AS (
  SELECT {keys}, avg(treated_y) AS mean_treated, avg(matched_control_y) AS mean_control, avg(pair_effect) AS effect,
         stddev_samp(pair_effect) AS sd, count(*) AS n_treated, sum(n_controls) AS n_control
  FROM pairs WHERE event_time IS NOT NULL AND pair_effect IS NOT NULL GROUP BY {keys} HAVING count(*) >= 2
),
pe0 AS (SELECT *, sd / sqrt(n_treated) AS se FROM pg),
eff AS (
  SELECT {keys}, mean_treated, mean_control, effect, se, CASE WHEN se > 0 THEN effect / se END AS t_stat,
         CASE WHEN se > 0 THEN {O.normal_two_sided_p_sql('effect / se')} END AS p_value, n_treated,
         CAST(n_control AS BIGINT) AS n_control,
         effect - {Z_975!r} * se AS ci_low, effect + {Z_975!r} * se AS ci_high
  FROM pe0
)"""


def sql_att(where: str, by_cohort: bool) -> str:
    keys = "cohort" if by_cohort else ""
    grp = f"GROUP BY {keys}" if by_cohort else ""
    having = "HAVING count(*) >= 2" if by_cohort else ""
    sel = f"{keys}," if by_cohort else ""
    ok = "n_periods >= 2"
    return f"""
a0 AS (
  SELECT {sel} count(*) AS n_periods, avg(effect) AS m, stddev_samp(effect) AS sd
  FROM eff WHERE effect IS NOT NULL AND {where} {grp} {having}
),
a1 AS (SELECT *, sd / sqrt(n_periods) AS se FROM a0)
SELECT {sel} CASE WHEN {ok} THEN m END AS ATT, CASE WHEN {ok} THEN se END AS SE,
       CASE WHEN {ok} AND se > 0 THEN m / se END AS t_stat,
       CASE WHEN {ok} AND se > 0 THEN {O.normal_two_sided_p_sql('m / se')} END AS p_value,
       CASE WHEN {ok} THEN m - 1.96 * se END AS CI_low, CASE WHEN {ok} THEN m + 1.96 * se END AS CI_high,
       n_periods
FROM a1"""


# ------------------------------------------------------------------ Spark chains
def panel_m1(s, d, price=None):
    mr = month_result(s, d)
    p = M.unweighted_panel(matches_s4(s, d, mr), mr)
    return p.where(F.col("price") == price) if price else p


def panel_m2(s, d, price="all"):
    mr = month_result(s, d)
    return M.pair_panel(matches_s4(s, d, mr), mr.where(F.col("price") == price) if price else mr)


def panel_m3(s, d, price="high"):
    mr = month_result(s, d)
    return M.weighted_panel(matches_cal_high(s, d, mr), prepare_price_panel(mr, price, OUT), OUT)


def eff_group(s, d, by_cohort=False):
    return E.add_confidence_interval(E.compute_effect(panel_m1(s, d, "high"), OUT, by_cohort))


def eff_pair(s, d, by_cohort=False):
    return E.add_confidence_interval(E.compute_pair_effect(panel_m2(s, d), by_cohort))


# ------------------------------------------------------------------ M
register("panel_unweighted", "M1", q(sql_m1(SQL_M_S4), "SELECT * FROM panel"))(lambda s, d: panel_m1(s, d))
register("panel_pairs", "M2", q(sql_m2(SQL_M_S4, "all"), "SELECT * FROM pairs"))(lambda s, d: panel_m2(s, d))
register("panel_weighted", "M3,P11", q(sql_m3(SQL_M_CAL, "high"), "SELECT * FROM wp"))(lambda s, d: panel_m3(s, d))

# ------------------------------------------------------------------ E
G_SQL = sql_m1(SQL_M_S4, "high")
register("effect_group", "E1,E5", q(G_SQL + "," + sql_effect("panel", False), "SELECT * FROM eff"))(
    lambda s, d: eff_group(s, d))
register("effect_group_cohort", "E2,E5", q(G_SQL + "," + sql_effect("panel", True), "SELECT * FROM eff"))(
    lambda s, d: eff_group(s, d, True))
P_SQL = sql_m2(SQL_M_S4, "all")
register("effect_pair", "E3,E5", q(P_SQL + "," + sql_pair_effect(False), "SELECT * FROM eff"))(
    lambda s, d: eff_pair(s, d))
register("effect_pair_cohort", "E4,E5", q(P_SQL + "," + sql_pair_effect(True), "SELECT * FROM eff"))(
    lambda s, d: eff_pair(s, d, True))


def _pretrend_sql(pairs: bool):
    base = (P_SQL + "," + sql_pair_effect(False)) if pairs else (G_SQL + "," + sql_effect("panel", False))
    return q(base + """,
pr AS (SELECT count(*) AS n_periods, avg(effect) AS m, stddev_samp(effect) AS sd
       FROM eff WHERE effect IS NOT NULL AND event_time BETWEEN -12 AND -1),
pr1 AS (SELECT *, m / NULLIF(sd / sqrt(n_periods), 0) AS t FROM pr)""", f"""
SELECT -12 AS pre_start, -1 AS pre_end, n_periods, CASE WHEN n_periods >= 2 THEN m END AS mean_pre_effect,
       CASE WHEN n_periods >= 2 THEN t END AS t_stat,
       CASE WHEN n_periods >= 2 THEN {O.t_two_sided_p_sql('t', 'n_periods - 1')} END AS p_value
FROM pr1""")


register("pretrend", "E6", _pretrend_sql(False))(lambda s, d: E.pretrend_test(eff_group(s, d)))
register("pretrend_pairs", "E6", _pretrend_sql(True))(lambda s, d: E.pretrend_test(eff_pair(s, d)))
def _att_q(where, by_cohort, pairs=False, cohort=False):
    base = (P_SQL + "," + sql_pair_effect(cohort)) if pairs else (G_SQL + "," + sql_effect("panel", cohort))
    body = sql_att(where, by_cohort)
    ctes, sel = body.split("\nSELECT", 1)
    return q(base + "," + ctes.rstrip().rstrip(","), "SELECT" + sel)


REGISTRY_ATT = [
    ("att_all", "E7", "event_time >= 0", False, False,
     lambda s, d: E.average_treatment_effect(eff_group(s, d))),
    ("att_3m", "E7", "event_time >= 0 AND event_time < 3", False, False,
     lambda s, d: E.average_treatment_effect(eff_group(s, d), max_post_periods=3)),
    ("att_cohort", "E8", "event_time >= 0", True, False,
     lambda s, d: E.att_by_cohort(eff_group(s, d, True))),
    ("att_cohort_3m", "E8", "event_time >= 0 AND event_time < 3", True, False,
     lambda s, d: E.att_by_cohort(eff_group(s, d, True), max_post_periods=3)),
    ("att_pairs", "E7", "event_time >= 0", False, True,
     lambda s, d: E.average_treatment_effect(eff_pair(s, d))),
    ("att_pairs_3m", "E7", "event_time >= 0 AND event_time < 3", False, True,
     lambda s, d: E.average_treatment_effect(eff_pair(s, d), max_post_periods=3)),
    ("att_pairs_cohort", "E8", "event_time >= 0", True, True,
     lambda s, d: E.att_by_cohort(eff_pair(s, d, True))),
    ("att_pairs_cohort_3m", "E8", "event_time >= 0 AND event_time < 3", True, True,
     lambda s, d: E.att_by_cohort(eff_pair(s, d, True), max_post_periods=3)),
]
for _n, _ops, _w, _bc, _pairs, _fn in REGISTRY_ATT:
    register(_n, _ops, _att_q(_w, _bc, _pairs, cohort=_bc))(_fn)


for _n, _key, _pairs in [
    ("effect_group", "overall", False), ("effect_group_cohort", "cohort", False), ("pretrend", "pretrend", False),
    ("att_all", "att_all", False), ("att_3m", "att_3m", False), ("att_cohort", "att_by_cohort_all", False),
    ("att_cohort_3m", "att_by_cohort_3m", False), ("effect_pair", "overall", True),
    ("effect_pair_cohort", "cohort", True), ("att_pairs", "att_all", True),
]:
    register(f"full_analysis_{'pair_' if _pairs else ''}{_key}", "E9", REGISTRY[_n].sql)(
        lambda s, d, key=_key, pairs=_pairs: E.run_full_analysis(
            panel_m2(s, d) if pairs else panel_m1(s, d, "high"), pairs=pairs)[key])


def _hist_sql(bins: int = 40, times=(-1, 0, 1, 2)) -> str:
    tl = ", ".join(str(t) for t in times)
    edge = "(CASE WHEN {i} = {n} THEN hi ELSE lo + {i} * ((hi - lo) / {n}.0) END)"
    e_i = edge.format(i="i0", n=bins)
    e_i1 = edge.format(i="(i0 + 1)", n=bins)
    return q(P_SQL + f""",
hx AS (SELECT event_time, pair_effect AS x FROM pairs WHERE pair_effect IS NOT NULL AND event_time IN ({tl})),
rng AS (
  SELECT event_time, min(x) AS mn, max(x) AS mx, avg(x) AS mean, count(*) AS n,
         CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
         CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi
  FROM hx GROUP BY event_time
),
b0 AS (
  SELECT h.event_time, h.x, r.lo, r.hi,
         least(CAST(floor((h.x - r.lo) * ({bins}.0 / (r.hi - r.lo))) AS INTEGER), {bins - 1}) AS i0
  FROM hx h JOIN rng r ON h.event_time = r.event_time
),
b1 AS (SELECT event_time, x, lo, hi, CASE WHEN x < {e_i} THEN i0 - 1 ELSE i0 END AS i0 FROM b0),
b2 AS (SELECT event_time, CASE WHEN x >= {e_i1} AND i0 <> {bins - 1} THEN i0 + 1 ELSE i0 END AS bin FROM b1),
cnt AS (SELECT event_time, bin, count(*) AS c FROM b2 GROUP BY 1, 2),
grid AS (SELECT r.*, CAST(g.bin AS INTEGER) AS bin FROM rng r, range(0, {bins}) g(bin))""", f"""
SELECT grid.event_time, grid.bin,
       CASE WHEN grid.bin = {bins} THEN hi ELSE lo + grid.bin * ((hi - lo) / {bins}.0) END AS bin_low,
       CASE WHEN grid.bin + 1 = {bins} THEN hi ELSE lo + (grid.bin + 1) * ((hi - lo) / {bins}.0) END AS bin_high,
       CAST(coalesce(cnt.c, 0) AS BIGINT) AS count, grid.mean
FROM grid LEFT JOIN cnt ON grid.event_time = cnt.event_time AND grid.bin = cnt.bin""")


register("pair_effect_hist", "E10", _hist_sql())(lambda s, d: E.pair_effect_histogram(panel_m2(s, d)))

# ------------------------------------------------------------------ D
W_SQL = sql_m3(SQL_M_CAL, "high")
register("twfe_weighted_means", "D1",
         q(W_SQL, f"SELECT entity_id, sum(match_weight * {OUT}) / sum(match_weight) AS {OUT}, "
                  "sum(match_weight * D) / sum(match_weight) AS D FROM wp GROUP BY entity_id"))(
    lambda s, d: D.weighted_group_mean(panel_m3(s, d), [OUT, "D"], "entity_id", "match_weight"))


def _fit_sql(panel: str, group: str, regs, src: str, select: str, drop_empty: bool = False, extra: str = "") -> str:
    ctes = panel + extra + "," + OD.fit(src, group, OUT, regs, drop_empty)
    return q(ctes.replace("WITH RECURSIVE", ""), select).replace("WITH ", "WITH RECURSIVE ", 1)


_D = [("D", "D")]
_COUNTS = (f", kept AS (SELECT cohort_id AS g, count(DISTINCT aID) FILTER (treatment = 1) AS n_treated,"
           " count(DISTINCT month_id) FILTER (D = 1) AS n_periods FROM wp GROUP BY 1"
           " HAVING count(DISTINCT aID) FILTER (treatment = 1) >= 5)"
           ", big AS (SELECT wp.* FROM wp JOIN kept ON kept.g = cohort_id)")


def _events(src: str, low: int, high: int) -> str:
    return f", win AS (SELECT * FROM {src} WHERE event_time BETWEEN {low} AND {high})"


register("did_basic", "D2,D3", _fit_sql(
    W_SQL, "'pooled'", _D, "wp", f"SELECT {OD.estimates()}, n_obs, n_entities FROM est"))(
    lambda s, d: D.fit_basic_did(panel_m3(s, d), OUT))
register("did_by_cohort", "D4", _fit_sql(
    W_SQL, "cohort_id", _D, "big",
    f"SELECT {OD.estimates('g AS cohort_id, ')}, n_treated, n_periods, n_obs, n_entities FROM est JOIN kept USING (g)",
    extra=_COUNTS))(
    lambda s, d: D.fit_basic_did(panel_m3(s, d), OUT, group_cols=["cohort_id"], min_treated=5))
_EVENT_SQL = _fit_sql(
    W_SQL, "'pooled'", OD.event_regressors(-12, 12, -1), "win",
    f"SELECT {OD.estimates()}, CAST(term AS INTEGER) AS event_time FROM est", True, _events("wp", -12, 12))
register("event_study", "D5,D6", _EVENT_SQL)(
    lambda s, d: D.fit_event_study(panel_m3(s, d), OUT, (-12, 12), -1))
register("event_study_by_cohort", "D7", _fit_sql(
    W_SQL, "cohort_id", OD.event_regressors(-12, 6, -1), "win",
    f"SELECT {OD.estimates('g AS cohort_id, n_treated, ')}, CAST(term AS INTEGER) AS event_time FROM est JOIN kept USING (g)",
    True, _COUNTS + _events("big", -12, 6)))(
    lambda s, d: D.fit_event_study(panel_m3(s, d), OUT, (-12, 6), -1, group_cols=["cohort_id"], min_treated=5))
def _did_by_price(s, d):
    mr = month_result(s, d)
    return D.fit_basic_did(D.price_panels(matches_cal_high(s, d, mr), mr), OUT, group_cols=["price"])


register("did_by_price", "D10", _fit_sql(
    sql_m3(SQL_M_CAL, "high").replace("WHERE price = 'high') mr", "WHERE price IN ('high', 'low', 'all')) mr"), "price", _D, "wp",
    f"SELECT {OD.estimates('g AS price, ')}, n_obs, n_entities FROM est"))(_did_by_price)
register("event_study_chart", "D8,D9", "SELECT * REPLACE (" + ", ".join(
    f"round({c}, 4) AS {c}" for c in ("coef", "std_error", "p_value", "ci_lower", "ci_upper"))
    + "), coef - 1.96::DOUBLE * std_error AS err_low, coef + 1.96::DOUBLE * std_error AS err_high FROM ("
    + _EVENT_SQL + ") r")(
    lambda s, d: D.round_results(D.coefficient_chart_data(
        D.fit_event_study(panel_m3(s, d), OUT, (-12, 12), -1), OUT)))



def _identification_sql(src: str, regressors, drop_empty: bool, more: str = "") -> str:
    """Components of the months by recursion over shared entities; ranks by the pivots of both eliminations."""
    return _fit_sql(W_SQL, "'pooled'", regressors, src, """,
linked AS (SELECT DISTINCT a.t AS u, b.t AS v FROM dat a JOIN dat b USING (e)),
walk AS (SELECT u, v FROM linked UNION SELECT w.u, l.v FROM walk w JOIN linked l ON l.u = w.v),
part AS (SELECT u, min(v) AS c FROM walk GROUP BY u),
pivots AS (SELECT count(*) AS r FROM fe, unnest(range(1, n + 1)) a(i) WHERE abs(m[i][i] - 1) < 1e-6),
lost AS (SELECT count(*) AS f FROM free)
SELECT n_obs, n_entities, CAST(n AS INTEGER) AS n_periods, (SELECT CAST(count(DISTINCT c) AS INTEGER) FROM part) AS n_components,
       CAST(r AS INTEGER) AS rank_time, CAST(kk AS INTEGER) AS n_regressors, CAST(kk - f AS INTEGER) AS rank_gram,
       f = 0 AS identified
FROM num, nt, size, pivots, lost""", drop_empty, more)


register("did_identification", "D2,D3", _identification_sql("wp", _D, False))(
    lambda s, d: D.identification(panel_m3(s, d), OUT))
register("event_identification", "D5,D6", _identification_sql(
    "win", OD.event_regressors(-12, 12, -1), True, _events("wp", -12, 12)))(
    lambda s, d: D.identification(panel_m3(s, d), OUT, (-12, 12), -1))
register("twfe_residuals", "D2", _fit_sql(
    W_SQL, "'pooled'", _D, "wp", "SELECT dat.e AS entity_id, dat.t AS month_id, res.r AS residual FROM res JOIN dat ON dat.rid = res.rid WHERE res.p = 0"))(
    lambda s, d: D.residualize_twfe(panel_m3(s, d).withColumn("_g", F.lit("pooled")), [OUT, "D"]).select(
        "entity_id", "month_id", F.col(f"{OUT}__r").alias("residual")))
