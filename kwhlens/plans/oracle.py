"""DuckDB SQL building blocks for the correctness oracle.

Each registered query has an independent SQL formulation over the raw test
tables (``lineitem``, ``supplier``, ``events``); these fragments are CTEs that
compose into those statements.  DuckDB differs from Spark in a few places
handled here: ``dayofweek`` is 0 = Sunday, ``hour`` is BIGINT, division by
zero gives inf (guarded with NULLIF).
"""

from __future__ import annotations

from kwhlens.functions import stats as S
from kwhlens.sources.readers import DEFAULT_HOLIDAYS

HOLIDAY_LIST = ", ".join(f"DATE '{d}'" for d in DEFAULT_HOLIDAYS)

READINGS_A = """
readings AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS aID,
         l_shipdate + INTERVAL 24 YEAR + to_hours(CAST((l_orderkey*7 + l_linenumber*5) % 24 AS INTEGER)) AS TIDPUNKT,
         l_quantity AS FORBRUKNING_KWH
  FROM lineitem
  WHERE l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL
)"""

TARIFF_A = """
tariff AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS aID,
         CAST(CAST(DATE '2023-03-01' + to_months(CAST(3*((s_suppkey//3)%4) AS INTEGER)) AS DATE)
              + CAST(CASE WHEN (s_suppkey//3)%2=1 THEN 14 ELSE 0 END AS INTEGER) AS TIMESTAMP) AS tariff_start,
         CASE WHEN s_suppkey % 2 = 0 THEN 'Tid 16 kW Villa' ELSE 'Tid 25 kW Normal' END AS tariff_plan
  FROM supplier WHERE s_suppkey % 3 = 0
)"""

READINGS_B = """
readings AS (
  SELECT CAST(user_id AS VARCHAR) AS aID, ts AS TIDPUNKT, value AS FORBRUKNING_KWH
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
)"""

TARIFF_B = """
tariff AS (
  SELECT CAST(user_id AS VARCHAR) AS aID,
         CAST(DATE '2024-01-08' + CAST(7*((user_id//3)%2) AS INTEGER) AS TIMESTAMP) AS tariff_start,
         CASE WHEN user_id % 2 = 0 THEN 'Tid 16 kW Villa' ELSE 'Tid 25 kW Normal' END AS tariff_plan
  FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 0) u
)"""

ENRICHED = f"""
enriched AS (
  SELECT r.aID, r.TIDPUNKT, r.FORBRUKNING_KWH, t.tariff_start, t.tariff_plan,
         CASE WHEN t.tariff_start IS NOT NULL THEN 1 ELSE 0 END AS has_tariff,
         CASE WHEN t.tariff_start IS NOT NULL AND r.TIDPUNKT >= t.tariff_start THEN 1 ELSE 0 END AS tariff_active,
         CASE WHEN month(r.TIDPUNKT) IN (11,12,1,2,3) AND dayofweek(r.TIDPUNKT) BETWEEN 1 AND 5
                   AND hour(r.TIDPUNKT) BETWEEN 7 AND 19
                   AND CAST(r.TIDPUNKT AS DATE) NOT IN ({HOLIDAY_LIST})
              THEN 'high' ELSE 'low' END AS price
  FROM readings r LEFT JOIN tariff t ON r.aID = t.aID
)"""


def period_sql(freq: str) -> str:
    if freq == "hour":
        return "CAST(hour(TIDPUNKT) AS INTEGER)"
    if freq == "weekday":
        return "CAST(dayofweek(TIDPUNKT) + 1 AS INTEGER)"
    if freq == "week_part":
        return "CASE WHEN dayofweek(TIDPUNKT) BETWEEN 1 AND 5 THEN 'weekday' ELSE 'weekend' END"
    return f"CAST(date_trunc('{freq}', TIDPUNKT) AS TIMESTAMP)"


def exploded(freq: str, use_price: bool = True) -> str:
    p = period_sql(freq)
    if not use_price:
        return f"""
ex AS (
  SELECT aID, {p} AS period, 'all' AS price, tariff_active, TIDPUNKT, FORBRUKNING_KWH AS kwh FROM enriched
)"""
    return f"""
ex AS (
  SELECT aID, {p} AS period, 'all' AS price, tariff_active, TIDPUNKT, FORBRUKNING_KWH AS kwh FROM enriched
  UNION ALL
  SELECT aID, {p} AS period, price, tariff_active, TIDPUNKT, FORBRUKNING_KWH AS kwh FROM enriched
)"""


KEYS = "aID, period, price, tariff_active"

PEAKS = f"""
dpk AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY {KEYS}, CAST(TIDPUNKT AS DATE)
                                 ORDER BY kwh DESC NULLS LAST, TIDPUNKT) AS rd
    FROM ex) WHERE rd = 1
),
rk AS (
  SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY kwh DESC NULLS LAST, TIDPUNKT) AS rk FROM dpk
),
peaks AS (
  SELECT {KEYS},
    max(CASE WHEN rk=1 THEN TIDPUNKT END) AS peak1_time, max(CASE WHEN rk=1 THEN kwh END) AS peak1_consumption,
    max(CASE WHEN rk=2 THEN TIDPUNKT END) AS peak2_time, max(CASE WHEN rk=2 THEN kwh END) AS peak2_consumption,
    max(CASE WHEN rk=3 THEN TIDPUNKT END) AS peak3_time, max(CASE WHEN rk=3 THEN kwh END) AS peak3_consumption
  FROM rk GROUP BY {KEYS}
)"""

TARIFF_INFO = r"""
tinfo AS (
  SELECT aID, min(tariff_start) AS tariff_start,
         NULLIF(regexp_extract(arg_min(tariff_plan, tariff_start), '(\d+\s*kW\s*(?:Villa|Normal))', 1), '') AS tariff_plan
  FROM tariff GROUP BY aID
)"""

USAGE = """
totals AS (SELECT aID, sum(FORBRUKNING_KWH) AS total_consumption FROM readings GROUP BY aID),
cuts AS (SELECT quantile_disc(total_consumption, 0.25) AS q1, quantile_disc(total_consumption, 0.75) AS q2 FROM totals),
usage AS (
  SELECT aID, total_consumption,
         CASE WHEN total_consumption <= q1 THEN 'low' WHEN total_consumption <= q2 THEN 'medium' ELSE 'high' END AS usage_group
  FROM totals, cuts
)"""


def month_result_ctes(panel: str = "A", freq: str = "month", use_price: bool = True) -> str:
    """CTEs ending in ``month_result`` = top3_mean + variance + mean + contract + usage."""
    src = (READINGS_A + "," + TARIFF_A) if panel == "A" else (READINGS_B + "," + TARIFF_B)
    return f"""{src},{ENRICHED},{exploded(freq, use_price)},{PEAKS},
stats AS (
  SELECT {KEYS}, var_samp(kwh) AS variance_consumption, avg(kwh) AS mean_consumption FROM ex GROUP BY {KEYS}
),{TARIFF_INFO},{USAGE},
month_result AS (
  SELECT s.aID, s.period AS TIDPUNKT, s.price, s.tariff_active,
         p.peak1_time, p.peak1_consumption, p.peak2_time, p.peak2_consumption, p.peak3_time, p.peak3_consumption,
         (p.peak1_consumption + p.peak2_consumption + p.peak3_consumption) / 3 AS top3_mean_consumption,
         s.variance_consumption, s.mean_consumption,
         ti.tariff_start, ti.tariff_plan, u.total_consumption, u.usage_group
  FROM stats s JOIN peaks p USING ({KEYS})
  LEFT JOIN tinfo ti ON s.aID = ti.aID
  LEFT JOIN usage u ON s.aID = u.aID
)"""


def with_ctes(ctes: str, body: str) -> str:
    return "WITH " + ctes.strip().lstrip(",") + "\n" + body


def normal_upper_tail_sql(x: str) -> str:
    """Same rational / continued-fraction formula as ``stats.normal_upper_tail``."""
    ax = f"abs({x})"

    def horner(coefs):
        acc = repr(coefs[0])
        for c in coefs[1:]:
            acc = f"({acc}) * {ax} + {c!r}"
        return acc

    expo = f"exp(-{ax}*{ax}/2.0)"
    cf = f"({ax} + 0.65)"
    for k in (4.0, 3.0, 2.0, 1.0):
        cf = f"({ax} + {k}/{cf})"
    lower = (
        f"(CASE WHEN {ax} > {S.NORM_CUTOFF} THEN 0.0 "
        f"WHEN {ax} < {S.NORM_SWITCH} THEN {expo} * ({horner(S.NORM_NUM)}) / ({horner(S.NORM_DEN)}) "
        f"ELSE {expo} / {cf} / {S.SQRT_2PI} END)"
    )
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 0 THEN {lower} ELSE 1.0 - {lower} END)"


def normal_two_sided_p_sql(t: str) -> str:
    return f"(2.0 * {normal_upper_tail_sql(f'abs({t})')})"


def t_two_sided_p_sql(t: str, df: str) -> str:
    """Student-t two-sided p (A&S 26.7.3/4) with closed-form series terms via lgamma."""
    df = f"({df})"  # an expression such as ``n - 1`` must bind before ``%`` and ``/``
    th = f"atan(abs({t}) / sqrt({df}))"
    c2 = f"pow(cos({th}), 2)"
    even_terms = (
        f"(SELECT sum(exp(lgamma(j + 0.5) - lgamma(j + 1) - 0.5*ln(pi())) * pow({c2}, j)) "
        f"FROM range(0, CAST(({df} - 2) / 2 AS BIGINT) + 1) r(j))"
    )
    odd_terms = (
        f"(SELECT sum(exp(j*ln(4.0) + 2*lgamma(j + 1) - lgamma(2*j + 2)) * pow({c2}, j)) "
        f"FROM range(0, CAST(({df} - 3) / 2 AS BIGINT) + 1) r(j))"
    )
    a_even = f"sin({th}) * {even_terms}"
    a_odd = f"(CASE WHEN {df} = 1 THEN 2.0*{th}/pi() ELSE (2.0/pi())*({th} + sin({th})*cos({th})*{odd_terms}) END)"
    return (
        f"(CASE WHEN {t} IS NULL OR {df} IS NULL OR {df} < 1 THEN NULL "
        f"WHEN {df} % 2 = 0 THEN 1.0 - {a_even} ELSE 1.0 - {a_odd} END)"
    )
