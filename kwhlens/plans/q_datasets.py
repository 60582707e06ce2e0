"""Registered queries for the descriptive datasets (C, T, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kwhlens.operators import aggregate as A
from kwhlens.operators import datasets as C
from kwhlens.operators import matched as M
from kwhlens.operators.readings import normalize_readings
from kwhlens.plans import oracle as O
from kwhlens.plans.q_effects import SQL_M_S4, matches_s4, sql_m1
from kwhlens.plans.q_matching import q
from kwhlens.plans.registry import month_result, register
from kwhlens.sources import fixtures as fx

OUT = "top3_mean_consumption"
COHORTS = ["2023-03", "2023-06", "2023-09", "2023-12"]
MR = O.month_result_ctes("A")
MONTH = "CAST(date_trunc('month', {c}) AS DATE)"
EVT = "CAST((year({a})*12 + month({a})) - (year({b})*12 + month({b})) AS INTEGER)"


def mr_all(s, d):
    return month_result(s, d).where(F.col("price") == "all")


def hour_result(s, d):
    return A.aggregate_readings(fx.panel_b_readings(s, d), fx.panel_b_tariff(s, d), freq="hour", agg_method="mean")


HR = f"""{O.READINGS_B},{O.TARIFF_B},{O.ENRICHED},{O.exploded("hour")},{O.TARIFF_INFO},
hr AS (
  SELECT s.*, ti.tariff_start, ti.tariff_plan FROM (
    SELECT aID, period AS TIDPUNKT, price, tariff_active, avg(kwh) AS mean_consumption FROM ex GROUP BY {O.KEYS}) s
  LEFT JOIN tinfo ti ON s.aID = ti.aID
)"""

# ------------------------------------------------------------------ C
register("consumption_profile", "C1",
         q(MR, f"SELECT TIDPUNKT, price, avg({OUT}) AS {OUT} FROM month_result WHERE price <> 'all' GROUP BY 1, 2"))(
    lambda s, d: C.consumption_profile(month_result(s, d), OUT, "mean", ["price"]))
register("consumption_profile_facet", "C1,C2",
         q(HR, "SELECT TIDPUNKT, price, tariff_active, tariff_plan, avg(mean_consumption) AS mean_consumption FROM hr "
               "WHERE (tariff_active = 1 OR tariff_start IS NULL) AND price <> 'all' GROUP BY 1, 2, 3, 4"))(
    lambda s, d: C.consumption_profile(hour_result(s, d), "mean_consumption", "mean", ["price", "tariff_active"],
                                       exclude_future_tariff=True, facet_by="tariff_plan"))
register("adopter_profile", "C3",
         q(MR, f"SELECT TIDPUNKT, price, CAST(tariff_start IS NOT NULL AS INTEGER) AS has_tariff, avg({OUT}) AS {OUT} "
               "FROM month_result WHERE price <> 'all' GROUP BY 1, 2, 3"))(
    lambda s, d: C.adopter_profile(month_result(s, d), OUT, by_price=True))
register("adoption_by_usage", "C4",
         q(MR, """SELECT o.usage_group, s.share_active, o."order" FROM (VALUES ('low', 0), ('medium', 1), ('high', 2))
               o(usage_group, "order") LEFT JOIN (SELECT usage_group, avg(tariff_active) AS share_active
               FROM month_result GROUP BY 1) s ON o.usage_group = s.usage_group"""))(
    lambda s, d: C.adoption_by_usage(month_result(s, d)))
register("descriptive_event_study", "C5",
         q(MR, f"""SELECT event_time, price, avg(mean_consumption) AS mean_consumption FROM (
               SELECT *, {EVT.format(a='TIDPUNKT', b='tariff_start')} AS event_time FROM month_result
               WHERE tariff_start IS NOT NULL) WHERE event_time BETWEEN -6 AND 6 GROUP BY 1, 2"""))(
    lambda s, d: C.descriptive_event_study(month_result(s, d), "mean_consumption", ["price"], 6))
register("cohort_calendar", "C6",
         q(MR, f"""SELECT {MONTH.format(c='TIDPUNKT')} AS TIDPUNKT, grp AS "group", avg({OUT}) AS {OUT} FROM (
               SELECT *, CASE WHEN {MONTH.format(c='tariff_start')} = DATE '2023-06-01' THEN 'treated'
                              WHEN tariff_start IS NULL THEN 'control' END AS grp
               FROM month_result WHERE price = 'all') WHERE grp IS NOT NULL GROUP BY 1, 2"""))(
    lambda s, d: C.cohort_calendar(mr_all(s, d), "2023-06", OUT))
_CL = ", ".join(f"'{c}'" for c in COHORTS)
register("cohort_multi", "C7",
         q(MR, f"""SELECT {MONTH.format(c='TIDPUNKT')} AS TIDPUNKT, grp AS "group", avg({OUT}) AS {OUT} FROM (
               SELECT *, CASE WHEN strftime(tariff_start, '%Y-%m') IN ({_CL}) THEN strftime(tariff_start, '%Y-%m')
                              WHEN tariff_start IS NULL THEN 'control' END AS grp
               FROM month_result WHERE price = 'all') WHERE grp IS NOT NULL GROUP BY 1, 2"""))(
    lambda s, d: C.cohort_multi(mr_all(s, d), COHORTS, OUT))
_CV = ", ".join(f"('{c}')" for c in COHORTS)
register("cohort_panels_raw", "C8",
         q(MR, f"""SELECT cohort, {MONTH.format(c='TIDPUNKT')} AS TIDPUNKT, grp AS "group", avg({OUT}) AS {OUT} FROM (
               SELECT *, strftime(tariff_start, '%Y-%m') AS cohort, 'treated' AS grp FROM month_result
               WHERE price = 'all' AND strftime(tariff_start, '%Y-%m') IN ({_CL})
               UNION ALL
               SELECT m.*, c.cohort, 'control' AS grp FROM month_result m, (VALUES {_CV}) c(cohort)
               WHERE m.price = 'all' AND m.tariff_start IS NULL) GROUP BY 1, 2, 3"""))(
    lambda s, d: C.cohort_panels(mr_all(s, d), COHORTS, "raw", OUT))
register("cohort_panels_matched", "C8",
         q(sql_m1(SQL_M_S4, "all"), f"""SELECT strftime(cohort, '%Y-%m') AS cohort, TIDPUNKT,
               CASE WHEN treatment = 1 THEN 'treated' ELSE 'control' END AS "group", avg({OUT}) AS {OUT}
               FROM panel WHERE strftime(cohort, '%Y-%m') IN ({_CL}) GROUP BY 1, 2, 3"""))(
    lambda s, d: C.cohort_panels(M.unweighted_panel(matches_s4(s, d), mr_all(s, d)), COHORTS, "matched", OUT))

# ------------------------------------------------------------------ T
TA = O.TARIFF_A
T1 = f"""SELECT {MONTH.format(c='tariff_start')} AS month, count(DISTINCT aID) AS n_households,
         strftime(date_trunc('month', tariff_start), '%Y-%m') AS label FROM tariff GROUP BY 1, 3"""
register("adoption_monthly", "T1", q(TA, T1))(lambda s, d: C.adoption_monthly(fx.panel_a_tariff(s, d)))
register("adoption_share", "T2",
         q(TA + "," + O.READINGS_A + f""",
t1 AS ({T1}),
t1b AS (SELECT min(month) AS lo, max(month) AS hi FROM t1),
grid AS (SELECT CAST(g AS DATE) AS month FROM t1b, generate_series(lo, hi, INTERVAL 1 MONTH) s(g)),
tot AS (SELECT count(DISTINCT aID) AS tot FROM readings),
f AS (SELECT g.month, coalesce(t1.n_households, 0) AS n_households FROM grid g LEFT JOIN t1 ON g.month = t1.month)""",
           """SELECT month, n_households,
              CAST(sum(n_households) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
                AS cumulative,
              sum(n_households) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                / CAST(tot AS DOUBLE) AS share
              FROM f, tot"""))(
    lambda s, d: C.adoption_share(fx.panel_a_tariff(s, d), normalize_readings(fx.panel_a_readings(s, d))))
register("plan_counts", "T3",
         q(TA, r"""SELECT g AS tariff_group, count(*) AS count FROM (
               SELECT NULLIF(regexp_extract(tariff_plan, '(\d+\s*kW\s*\w+)', 1), '') AS g FROM tariff)
               WHERE g IS NOT NULL GROUP BY 1"""))(lambda s, d: C.plan_counts(fx.panel_a_tariff(s, d)))
register("plan_cumulative", "T4",
         q(TA + r""",
tp AS (SELECT *, NULLIF(regexp_extract(tariff_plan, '(\d+\s*kW\s*(?:Villa|Normal))', 1), '') AS plan FROM tariff),
mp AS (SELECT CAST(date_trunc('month', tariff_start) AS DATE) AS month, plan, count(DISTINCT aID) AS n
       FROM tp WHERE plan IS NOT NULL GROUP BY 1, 2),
b AS (SELECT min(month) AS lo, max(month) AS hi FROM mp),
grid AS (SELECT CAST(g AS DATE) AS month, p.plan FROM b, generate_series(lo, hi, INTERVAL 1 MONTH) s(g),
         (SELECT DISTINCT plan FROM mp) p),
f AS (SELECT grid.month, grid.plan, coalesce(mp.n, 0) AS n_households FROM grid
      LEFT JOIN mp ON grid.month = mp.month AND grid.plan = mp.plan)""",
           """SELECT month, plan, n_households, CAST(sum(n_households) OVER (PARTITION BY plan ORDER BY month
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative FROM f"""))(
    lambda s, d: C.plan_cumulative(fx.panel_a_tariff(s, d)))

# ------------------------------------------------------------------ K
PK = MR + ",\npk AS (" + "\nUNION ALL\n".join(
    f"SELECT aID, tariff_start, tariff_active, peak{i}_time AS time, CAST(peak{i}_consumption AS DOUBLE) AS consumption,"
    f" {i} AS peak_rank FROM month_result WHERE price = 'all'"
    for i in (1, 2, 3)
) + """),
pl AS (SELECT *, CAST(month(time) AS INTEGER) AS month, CAST(hour(time) AS INTEGER) AS hour FROM pk
       WHERE time IS NOT NULL AND consumption IS NOT NULL)"""

register("peaks_long", "K1", q(PK, "SELECT time, consumption, peak_rank, month, hour FROM pl"))(
    lambda s, d: C.peaks_long(mr_all(s, d)))
register("peak_hours", "K2", q(PK, "SELECT hour, CAST(count(*) AS DOUBLE) AS value FROM pl GROUP BY 1"))(
    lambda s, d: C.peak_hours(mr_all(s, d), "count"))
register("peak_hours_consumption", "K2", q(PK, "SELECT hour, sum(consumption) AS value FROM pl GROUP BY 1"))(
    lambda s, d: C.peak_hours(mr_all(s, d), "consumption"))
register("peak_heatmap", "K3",
         q(PK, """SELECT g.month, g.hour, coalesce(c.value, 0.0) AS value
               FROM (SELECT CAST(m AS INTEGER) AS month, CAST(h AS INTEGER) AS hour FROM range(1, 13) a(m), range(0, 24) b(h)) g
               LEFT JOIN (SELECT month, hour, CAST(count(*) AS DOUBLE) AS value FROM pl GROUP BY 1, 2) c
               ON g.month = c.month AND g.hour = c.hour"""))(lambda s, d: C.peak_heatmap(mr_all(s, d), "count"))


def hist_sql(src: str, col: str, keys: list[str], bins: int) -> str:
    kc = ", ".join(keys)
    ks = (kc + ", ") if keys else ""
    on = " AND ".join(f"h.{k} = r.{k}" for k in keys) or "TRUE"
    on2 = " AND ".join(f"grid.{k} = cnt.{k}" for k in keys)
    on2 = (on2 + " AND ") if keys else ""
    grp = f"GROUP BY {kc}" if keys else ""
    edge = "(CASE WHEN {i} = {n} THEN hi ELSE lo + {i} * ((hi - lo) / {n}.0) END)"
    return f"""
hx AS (SELECT {ks}{col} AS x FROM {src} WHERE {col} IS NOT NULL),
rng AS (
  SELECT {ks} avg(x) AS mean, count(*) AS n,
         CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
         CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi
  FROM hx {grp}
),
b0 AS (
  SELECT {", ".join(f"h.{k}" for k in keys) + ", " if keys else ""}h.x, r.lo, r.hi,
         least(CAST(floor((h.x - r.lo) * ({bins}.0 / (r.hi - r.lo))) AS INTEGER), {bins - 1}) AS i0
  FROM hx h JOIN rng r ON {on}
),
b1 AS (SELECT *, CASE WHEN x < {edge.format(i="i0", n=bins)} THEN i0 - 1 ELSE i0 END AS i1 FROM b0),
b2 AS (SELECT {ks} CASE WHEN x >= {edge.format(i="(i1 + 1)", n=bins)} AND i1 <> {bins - 1} THEN i1 + 1 ELSE i1 END
       AS bin FROM b1),
cnt AS (SELECT {ks} bin, count(*) AS c FROM b2 GROUP BY {ks} bin),
grid AS (SELECT r.*, CAST(g.bin AS INTEGER) AS bin FROM rng r, range(0, {bins}) g(bin)),
hist AS (
  SELECT {", ".join(f"grid.{k}" for k in keys) + ", " if keys else ""}grid.bin,
         {edge.format(i="grid.bin", n=bins)} AS bin_low, {edge.format(i="(grid.bin + 1)", n=bins)} AS bin_high,
         CAST(coalesce(cnt.c, 0) AS BIGINT) AS count, grid.mean
  FROM grid LEFT JOIN cnt ON {on2} grid.bin = cnt.bin
)"""


register("peak_hist", "K4", q(PK + "," + hist_sql("pl", "consumption", [], 30), "SELECT * FROM hist"))(
    lambda s, d: C.peak_hist(mr_all(s, d), 30))
register("peak_box", "K5",
         q(PK + """,
qs AS (SELECT peak_rank, count(*) AS n, quantile_cont(consumption, 0.25) AS q1, quantile_cont(consumption, 0.5) AS median,
       quantile_cont(consumption, 0.75) AS q3 FROM pl GROUP BY 1),
qs2 AS (SELECT *, q3 - q1 AS iqr FROM qs)""",
           """SELECT q.peak_rank, q.n, q.q1, q.median, q.q3, q.iqr,
              min(CASE WHEN p.consumption >= q.q1 - 1.5 * q.iqr THEN p.consumption END) AS whisker_low,
              max(CASE WHEN p.consumption <= q.q3 + 1.5 * q.iqr THEN p.consumption END) AS whisker_high
              FROM qs2 q JOIN pl p ON q.peak_rank = p.peak_rank GROUP BY 1, 2, 3, 4, 5, 6"""))(
    lambda s, d: C.peak_box(mr_all(s, d)))


def seg_sql(agg: str) -> str:
    val = {"count": "CAST(count(*) AS DOUBLE)", "sum": "sum(consumption)", "mean": "avg(consumption)"}[agg]
    fill = "value" if agg == "mean" else "coalesce(value, 0.0)"
    return PK + f""",
sg AS (SELECT *, CASE WHEN tariff_start IS NULL THEN 'never' WHEN tariff_active = 1 THEN 'after'
                      WHEN tariff_active = 0 THEN 'before' END AS segment FROM pl),
cells AS (SELECT segment, month, hour, {val} AS value FROM sg WHERE segment IS NOT NULL GROUP BY 1, 2, 3),
grid AS (SELECT s.segment, m.month, CAST(h AS INTEGER) AS hour
         FROM (SELECT DISTINCT month FROM sg WHERE segment IS NOT NULL) m, range(0, 24) r(h),
              (VALUES ('never'), ('before'), ('after')) s(segment)),
fullg AS (SELECT g.segment, g.month, g.hour, {fill.replace('value', 'c.value')} AS value FROM grid g
          LEFT JOIN cells c ON g.segment = c.segment AND g.month = c.month AND g.hour = c.hour),
seg AS (
  SELECT * FROM fullg
  UNION ALL
  SELECT 'diff' AS segment, month, hour,
         max(CASE WHEN segment = 'after' THEN value END) - max(CASE WHEN segment = 'before' THEN value END) AS value
  FROM fullg GROUP BY month, hour
)"""


for _agg, _name, _ops in (("count", "segment_heatmap_count", "K6"), ("sum", "segment_heatmap_sum", "K7"),
                          ("mean", "segment_heatmap_mean", "K7")):
    register(_name, _ops, q(seg_sql(_agg), "SELECT * FROM seg"))(
        (lambda a: lambda s, d: C.segment_heatmap(mr_all(s, d), a))(_agg))

register("peak_scale_limits", "K8",
         q(seg_sql("count"), """SELECT coalesce(max(CASE WHEN segment = 'never' THEN value END), 0.0) AS vmax_never,
               coalesce(max(CASE WHEN segment IN ('before', 'after') THEN value END), 0.0) AS vmax_adopters,
               coalesce(max(CASE WHEN segment = 'diff' THEN abs(value) END), 0.0) AS diff_abs_max FROM seg"""))(
    lambda s, d: C.scale_limits(C.segment_heatmap(mr_all(s, d), "count")))
