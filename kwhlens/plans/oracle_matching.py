"""DuckDB SQL fragments for panels, risk sets, profiles, matching and balance.

Each function returns one or more CTEs (``name AS (...)``) that read the CTE
produced by the previous stage; the statements are independent formulations
(plain range joins, window functions, CASE pivots) of the Spark operators.
"""

from __future__ import annotations

from collections.abc import Sequence

Q = '"group"'
# Fixed values, written out here so that the SQL does not lean on the operators: outcome columns, summary
# features and month names.
VALUE_COLS = ["top3_mean_consumption", "mean_consumption", "variance_consumption", "total_consumption"]
SUMMARY_BASE = ["peak_mean", "peak_sd", "peak_volatility", "mean_consumption", "variance_consumption", "total_consumption", "trend"]
MONTH_ABBR = {1: "jan", 2: "feb", 3: "mar", 4: "apr", 5: "may", 6: "jun", 7: "jul", 8: "aug", 9: "sep", 10: "oct", 11: "nov", 12: "dec"}


def price_suffix(price: str) -> str:
    return price.replace("-", "_").replace(" ", "_")


def calendar_feature_names(months: Sequence[int], years: int, suffixes: Sequence[str]) -> list[str]:
    return sorted((f"{s}_" if s else "") + f"{MONTH_ABBR[m]}_{y + 1}" for m in months for y in range(years) for s in suffixes)


def base_single(price: str | None) -> str:
    where = f"WHERE price = '{price}'" if price else ""
    vals = ", ".join(VALUE_COLS)
    return f"""
base AS (
  SELECT aID AS id, CAST(TIDPUNKT AS DATE) AS month, CAST(tariff_start AS DATE) AS adoption_month, {vals}
  FROM month_result {where}
)"""


def base_wide(prices: Sequence[str]) -> str:
    cols = []
    for pv in prices:
        s = price_suffix(pv)
        for c in VALUE_COLS:
            cols.append(
                f"coalesce(max(CASE WHEN price = '{pv}' AND tariff_active = 0 THEN {c} END),"
                f" max(CASE WHEN price = '{pv}' AND tariff_active <> 0 THEN {c} END)) AS {c}_{s}"
            )
    plist = ", ".join(f"'{p}'" for p in prices)
    return f"""
base AS (
  SELECT aID AS id, CAST(TIDPUNKT AS DATE) AS month, min(CAST(tariff_start AS DATE)) AS adoption_month,
         {", ".join(cols)}
  FROM month_result WHERE price IN ({plist}) GROUP BY 1, 2
)"""


def value_cols(prices: Sequence[str] | None) -> list[str]:
    if not prices or len(prices) == 1:
        return list(VALUE_COLS)
    return [f"{c}_{price_suffix(p)}" for p in prices for c in VALUE_COLS]


def risk(L: int, control_type: str, vals: Sequence[str], match_months=None) -> str:
    rule = "(s.st = t.Ti OR s.st IS NULL)"
    if control_type == "risk_set":
        rule = "(s.st = t.Ti OR s.st IS NULL OR s.st > t.Ti)"
    mm = ""
    if match_months:
        mm = f"AND month(b.month) IN ({', '.join(str(m) for m in match_months)})"
    v = ", ".join(f"b.{c}" for c in vals)
    return f"""
ti AS (SELECT DISTINCT adoption_month AS Ti FROM base WHERE adoption_month IS NOT NULL),
status AS (SELECT id, min(adoption_month) AS st FROM base GROUP BY id),
risk AS (
  SELECT b.id, t.Ti, s.st AS adoption_month,
         CASE WHEN s.st = t.Ti THEN 'treated' ELSE 'control' END AS {Q}, b.month, {v}
  FROM base b JOIN status s ON b.id = s.id CROSS JOIN ti t
  WHERE b.month < t.Ti AND b.month >= CAST(t.Ti - INTERVAL {int(L)} MONTH AS DATE) AND {rule} {mm}
)"""


def _order(vals: Sequence[str], desc: bool = False) -> str:
    m = "month DESC" if desc else "month"
    return ", ".join([m] + [f"{c} ASC NULLS FIRST" for c in sorted(vals)])


def summary_profile(vals: Sequence[str], suffixes: Sequence[str], out_vars: Sequence[str], src: str = "risk",
                    name: str = "prof") -> str:
    win = f"PARTITION BY Ti, id ORDER BY {_order(vals)}"
    sel = [f"CAST(row_number() OVER ({win}) AS DOUBLE) AS x"]
    aggs = ["count(*) AS n_obs"]
    for s in suffixes:
        t = f"_{s}" if s else ""
        y = f"top3_mean_consumption{t}"
        sel.append(f"CAST({y} AS DOUBLE) AS y{t}")
        sel.append(f"lag({y}) OVER ({win}) AS yp{t}")
        aggs += [
            f"avg(y{t}) AS peak_mean{t}",
            f"stddev_samp(y{t}) AS peak_sd{t}",
            f"avg(CASE WHEN yp{t} IS NOT NULL AND y{t} IS NOT NULL THEN abs(y{t} - yp{t}) END) AS peak_volatility{t}",
            f"avg(mean_consumption{t}) AS mean_consumption{t}",
            f"avg(variance_consumption{t}) AS variance_consumption{t}",
            f"avg(total_consumption{t}) AS total_consumption{t}",
            f"sum(x) AS sx{t}", f"sum(y{t}) AS sy{t}", f"sum(x*y{t}) AS sxy{t}", f"sum(x*x) AS sx2{t}",
        ]
    trends = []
    for s in suffixes:
        t = f"_{s}" if s else ""
        trends.append(f"(n_obs*sxy{t} - sx{t}*sy{t}) / NULLIF(n_obs*sx2{t} - sx{t}*sx{t}, 0) AS trend{t}")
    return f"""
{name}_rr AS (SELECT *, {", ".join(sel)} FROM {src}),
{name}0 AS (
  SELECT Ti, id, adoption_month, {Q}, {", ".join(aggs)} FROM {name}_rr GROUP BY Ti, id, adoption_month, {Q}
  HAVING count(*) >= 2
),
{name}1 AS (SELECT *, {", ".join(trends)} FROM {name}0),
{name} AS (SELECT Ti, id, adoption_month, {Q}, {", ".join(out_vars)} FROM {name}1)"""


def summary_vars_all(suffixes: Sequence[str]) -> list[str]:
    return [f"{v}_{s}" if s else v for s in suffixes for v in SUMMARY_BASE]


def calendar_profile(months: Sequence[int], years: int, suffixes: Sequence[str], src: str = "risk",
                     name: str = "prof") -> str:
    abbr = "CASE " + " ".join(f"WHEN month(month) = {k} THEN '{v}'" for k, v in MONTH_ABBR.items()) + " END"
    mb = "((year(Ti) - year(month))*12 + (month(Ti) - month(month)))"
    cols = []
    for n in calendar_feature_names(months, years, suffixes):
        if suffixes == [""]:
            cols.append(f"max(CASE WHEN fname = '{n}' THEN top3_mean_consumption END) AS {n}")
        else:
            s = next(x for x in suffixes if n.startswith(x + "_"))
            cols.append(f"max(CASE WHEN fname = '{n[len(s) + 1:]}' THEN top3_mean_consumption_{s} END) AS {n}")
    mlist = ", ".join(str(m) for m in months)
    return f"""
{name}_src AS (
  SELECT *, {abbr} || '_' || CAST(CAST(floor(({mb} - 1) / 12) + 1 AS BIGINT) AS VARCHAR) AS fname FROM {src}
  WHERE {mb} BETWEEN 1 AND {12 * years} AND month(month) IN ({mlist})
),
{name} AS (SELECT Ti, id, adoption_month, {Q}, {", ".join(cols)} FROM {name}_src GROUP BY Ti, id, adoption_month, {Q})"""


def lag_profile(L: int, vals: Sequence[str]) -> str:
    cols = [f"max(CASE WHEN lag_idx = {i} THEN top3_mean_consumption END) AS peak_lag_{i}" for i in range(1, L + 1)]
    valid = " + ".join(f"CAST(peak_lag_{i} IS NOT NULL AS INTEGER)" for i in range(1, L + 1))
    return f"""
lr AS (SELECT *, row_number() OVER (PARTITION BY Ti, id ORDER BY {_order(vals, desc=True)}) AS lag_idx FROM risk),
prof0 AS (SELECT Ti, id, adoption_month, {Q}, {", ".join(cols)} FROM lr WHERE lag_idx <= {L}
          GROUP BY Ti, id, adoption_month, {Q}),
prof AS (SELECT *, {valid} AS valid_dim FROM prof0)"""


def standardize(features: Sequence[str], src: str = "prof") -> str:
    stats = ", ".join(f"avg({c}) AS {c}__m, stddev_samp({c}) AS {c}__s" for c in features)
    zs = ", ".join(
        f"(p.{c} - st.{c}__m) / (CASE WHEN st.{c}__s IS NULL OR st.{c}__s = 0 THEN 1.0 ELSE st.{c}__s END) AS {c}_z"
        for c in features
    )
    raw = ", ".join(f"p.{c}" for c in features)
    return f"""
cstats AS (SELECT Ti, {stats} FROM {src} WHERE {Q} = 'control' GROUP BY Ti),
pz AS (
  SELECT p.Ti, p.id, p.adoption_month, p.{Q}, {raw}, {zs}
  FROM {src} p LEFT JOIN cstats st ON p.Ti = st.Ti
)"""


def knn_blocked(features: Sequence[str], k: int, thr: float | None, block: str | None) -> str:
    ok_t = " AND ".join(f"{c}_z IS NOT NULL" for c in features)
    dist = " + ".join(f"pow(t.{c}_z - c.{c}_z, 2)" for c in features)
    theta = ""
    if block:
        theta = f"AND abs(c.{block} - t.{block}) <= CAST({thr!r} AS DOUBLE) * abs(t.{block})"
    return f"""
tq AS (SELECT * FROM pz WHERE {Q} = 'treated' AND {ok_t}),
cq AS (SELECT * FROM pz WHERE {Q} = 'control' AND {ok_t}),
cand AS (
  SELECT t.Ti, t.id AS tid, c.id AS cid, sqrt({dist}) AS distance
  FROM tq t JOIN cq c ON t.Ti = c.Ti AND t.id <> c.id {theta}
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY Ti, tid ORDER BY distance, cid) AS match_rank FROM cand),
matches AS (
  SELECT tid AS treated_id, cid AS control_id, Ti AS adoption_month, distance, CAST(match_rank AS INTEGER) AS match_rank
  FROM ranked WHERE match_rank <= {int(k)}
)"""


def knn_candidates_missing(features: Sequence[str]) -> str:
    sq = " + ".join(
        f"(CASE WHEN t.{c}_z IS NOT NULL AND c.{c}_z IS NOT NULL THEN pow(t.{c}_z - c.{c}_z, 2) ELSE 0.0 END)"
        for c in features
    )
    cnt = " + ".join(
        f"(CASE WHEN t.{c}_z IS NOT NULL AND c.{c}_z IS NOT NULL THEN 1 ELSE 0 END)" for c in features
    )
    return f"""
cand0 AS (
  SELECT t.Ti, t.id AS tid, c.id AS cid, {sq} AS sq, CAST({cnt} AS INTEGER) AS valid_dim
  FROM (SELECT * FROM pz WHERE {Q} = 'treated') t JOIN (SELECT * FROM pz WHERE {Q} = 'control') c
    ON t.Ti = c.Ti AND t.id <> c.id
)"""


def knn_missing(features: Sequence[str], k: int, min_valid: int | None = None) -> str:
    mv = max(2, len(features) * 3 // 10) if min_valid is None else min_valid  # 30 % of the features, 2 at least
    return knn_candidates_missing(features) + f""",
cand AS (SELECT *, sqrt(sq / valid_dim) AS distance FROM cand0 WHERE valid_dim >= {mv}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY Ti, tid ORDER BY distance, cid) AS match_rank FROM cand),
matches AS (
  SELECT tid AS treated_id, cid AS control_id, Ti AS adoption_month, distance, valid_dim,
         CAST(match_rank AS INTEGER) AS match_rank
  FROM ranked WHERE match_rank <= {int(k)}
)"""


def matched_ids_cte(name: str = "mids") -> str:
    return f"""
{name} AS (
  SELECT DISTINCT treated_id AS id, adoption_month AS Ti, 'treated' AS {Q} FROM matches
  UNION ALL
  SELECT DISTINCT control_id AS id, adoption_month AS Ti, 'control' AS {Q} FROM matches
)"""


def matched_profiles(features: Sequence[str]) -> str:
    raw = ", ".join(f"p.{c}" for c in features)
    zs = ", ".join(f"p.{c}_z" for c in features)
    return matched_ids_cte() + f""",
mp AS (
  SELECT p.Ti, p.id, p.adoption_month, m.{Q}, {raw}, {zs}
  FROM pz p JOIN mids m ON p.id = m.id AND p.Ti = m.Ti
)"""


def balance(features: Sequence[str], src: str, pool: bool) -> str:
    parts = []
    for c in features:
        tm = f"avg(CASE WHEN {Q} = 'treated' THEN {c} END)"
        cm = f"avg(CASE WHEN {Q} = 'control' THEN {c} END)"
        tv = f"var_samp(CASE WHEN {Q} = 'treated' THEN {c} END)"
        cv = f"var_samp(CASE WHEN {Q} = 'control' THEN {c} END)"
        smd = f"({tm} - {cm}) / NULLIF(sqrt(({tv} + {cv}) / 2.0), 0)"
        if pool:
            parts.append(
                f"SELECT '{c}' AS covariate, CAST({tm} AS DOUBLE) AS treated_mean, CAST({cm} AS DOUBLE) AS control_mean,"
                f" {smd} AS SMD FROM {src}"
            )
        else:
            parts.append(
                f"SELECT Ti, '{c}' AS covariate, CAST({tm} AS DOUBLE) AS treated_mean,"
                f" CAST({cm} AS DOUBLE) AS control_mean, {smd} AS SMD FROM {src} GROUP BY Ti"
                f" HAVING count(CASE WHEN {Q} = 'treated' THEN 1 END) > 0"
                f" AND count(CASE WHEN {Q} = 'control' THEN 1 END) > 0"
            )
    return "\nUNION ALL\n".join(parts)


def validation_rows(start: int, end: int, vals: Sequence[str], name: str) -> str:
    """Base rows of matched units (``mids``) in ``[Ti - start, Ti - end)`` months."""
    v = ", ".join(f"b.{c}" for c in vals)
    return f"""
{name} AS (
  SELECT m.id, m.Ti, m.{Q}, b.month, b.adoption_month, {v}
  FROM mids m JOIN base b ON b.id = m.id
  WHERE b.month < CAST(m.Ti - INTERVAL {int(end)} MONTH AS DATE)
    AND b.month >= CAST(m.Ti - INTERVAL {int(start)} MONTH AS DATE)
)"""


def tagged_balance(features: Sequence[str], src: str, check: str, start: int, end: int) -> str:
    """Pooled and per-cohort balance of ``src`` in the long validation layout."""
    tag = f"'{check}' AS \"check\", {int(start)} AS window_start, {int(end)} AS window_end"
    return (
        f"SELECT {tag}, 'overall' AS scope, CAST(NULL AS DATE) AS Ti, covariate, treated_mean, control_mean, SMD"
        f" FROM ({balance(features, src, True)}) o\nUNION ALL\n"
        f"SELECT {tag}, 'by_ti' AS scope, Ti, covariate, treated_mean, control_mean, SMD"
        f" FROM ({balance(features, src, False)}) b"
    )
