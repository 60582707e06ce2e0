"""Covariate balance and hold-out validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kwhlens.operators.matching import matched_ids
from kwhlens.operators.panel import PANEL_KEYS
from kwhlens.operators.profiles import (
    all_summary_vars,
    build_calendar_profiles,
    build_summary_profiles,
    calendar_feature_names,
    detect_price_suffixes,
)

SMD_THRESHOLD = 0.1


def _smd_sql(tm: str, cm: str, tv: str, cv: str) -> str:
    """Signed standardised mean difference as SQL text, NULL when the pooled sd is 0 or NULL."""
    den = f"sqrt(({tv} + {cv}) / 2.0)"
    return f"try_divide({tm} - {cm}, CASE WHEN {den} != 0 THEN {den} END)"


def _balance_exprs(feature_cols: Sequence[str]) -> tuple[list, str]:
    """Aggregates per covariate and group, and the ``inline`` that makes a row of each covariate (SQL text: few calls)."""
    tr, co = "`group` = 'treated'", "`group` = 'control'"
    aggs = [f"count(CASE WHEN {tr} THEN 1 END) AS _nt", f"count(CASE WHEN {co} THEN 1 END) AS _nc"]
    rows = []
    for i, c in enumerate(feature_cols):
        aggs += [
            f"avg(CASE WHEN {tr} THEN `{c}` END) AS _tm{i}",
            f"avg(CASE WHEN {co} THEN `{c}` END) AS _cm{i}",
            f"var_samp(CASE WHEN {tr} THEN `{c}` END) AS _tv{i}",
            f"var_samp(CASE WHEN {co} THEN `{c}` END) AS _cv{i}",
        ]
        lit = c.replace("'", "\\'")
        rows.append(
            f"named_struct('covariate', '{lit}', 'treated_mean', CAST(_tm{i} AS DOUBLE),"
            f" 'control_mean', CAST(_cm{i} AS DOUBLE), 'SMD', {_smd_sql(f'_tm{i}', f'_cm{i}', f'_tv{i}', f'_cv{i}')})"
        )
    return [F.expr(a) for a in aggs], f"inline(array({', '.join(rows)}))"


def balance_table(profiles: DataFrame, feature_cols: Sequence[str], pool: bool = True) -> DataFrame:
    """B1 (by cohort, ``pool=False``) / B2 (pooled): one row per covariate.

    One aggregate with conditional means / variances per group replaces
    two aggregates + join; ``inline`` unpivots.  By cohort only
    cohorts with both groups are reported.
    """
    aggs, rows = _balance_exprs(feature_cols)
    if pool:
        return profiles.agg(*aggs).selectExpr(rows)
    return profiles.groupBy("Ti").agg(*aggs).where("_nt > 0 AND _nc > 0").selectExpr("Ti", rows)


def balance_scopes(profiles: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """B1 and B2 in one pass: ``scope`` (overall or by_ti), ``Ti`` (NULL when pooled) and the columns of ``balance_table``."""
    aggs, rows = _balance_exprs(feature_cols)
    wide = profiles.rollup("Ti").agg(F.grouping("Ti").alias("_pooled"), *aggs)
    return wide.where("_pooled = 1 OR (_nt > 0 AND _nc > 0)").selectExpr(
        "CASE WHEN _pooled = 1 THEN 'overall' ELSE 'by_ti' END AS scope", "Ti", rows)


def love_data(balance: DataFrame, threshold: float = SMD_THRESHOLD) -> DataFrame:
    """|SMD| per covariate with the 0.1 flag, ascending (love-plot order)."""
    return (
        balance.withColumn("abs_SMD", F.abs("SMD"))
        .withColumn("above_threshold", F.col("abs_SMD") > F.lit(threshold))
        .orderBy(F.col("abs_SMD").asc_nulls_first(), "covariate")
    )


def _check_window(start: int, end: int) -> None:
    if start <= end:
        raise ValueError(f"a window from {start} to {end} months before adoption is empty")


def validation_rows(matched: DataFrame, base: DataFrame, start_month: int, end_month: int) -> DataFrame:
    """V1: base rows of matched units in ``[Ti − start, Ti − end)`` months.

    Equi-join on the unit id (a unit has at most one row per month and is
    matched in a handful of cohorts), then the range filter.
    """
    _check_window(start_month, end_month)
    value_cols = [c for c in base.columns if c not in PANEL_KEYS]
    m = matched.select("id", "Ti", "group")
    return (
        m.join(base, "id")
        .where((F.col("month") < F.add_months("Ti", -end_month)) & (F.col("month") >= F.add_months("Ti", -start_month)))
        .select("id", "Ti", "group", "month", "adoption_month", *value_cols)
    )


def validation_balance(
    matches: DataFrame,
    base: DataFrame,
    match_vars: Sequence[str],
    match_start_month: int = 24,
    match_end_month: int = 12,
    extra_start_month: int = 24,
    extra_end_month: int = 12,
    calendar_start_month: int = 24,
    calendar_end_month: int = 0,
    check_calendar: bool = True,
    calendar_months: Sequence[int] = (1, 2, 3, 11, 12),
    calendar_years: int = 2,
    persist: str = "table",
) -> DataFrame:
    """V2–V5: balance of matched units on windows outside the matching window.

    One long table: ``check`` ∈ {matching, non_matching, calendar}, window,
    ``scope`` ∈ {overall, by_ti}, ``Ti`` (NULL when pooled), covariate,
    treated/control means and SMD.  Matching variables not produced by the
    summary profile (lag or calendar features) are skipped.

    The matched ids are joined to the base panel once, over the widest window; the
    joined rows (``persist``: by default a table in the shared folder) serve every window.  Checks of the same window
    share one profile, and pooled and by-cohort balance come from one ROLLUP.
    """
    from kwhlens.session import materialize

    all_vars = all_summary_vars(base.columns)
    groups: dict[tuple, list] = {}  # (profile, window): checks and their covariates
    for check, cols, *window in (
            ("matching", [v for v in match_vars if v in all_vars], match_start_month, match_end_month),
            ("non_matching", [v for v in all_vars if v not in match_vars], extra_start_month, extra_end_month)):
        if cols:
            groups.setdefault(("summary", *window), []).append((check, cols))
    if check_calendar:
        cols = calendar_feature_names(calendar_months, calendar_years, detect_price_suffixes(base.columns))
        groups.setdefault(("calendar", calendar_start_month, calendar_end_month), []).append(("calendar", cols))
    for _, start, end in groups:
        _check_window(start, end)
    rows = materialize(validation_rows(
        matched_ids(matches), base, max(g[1] for g in groups), min(g[2] for g in groups)), persist)
    parts: list[DataFrame] = []
    for (kind, start, end), checks in groups.items():
        own = rows.where((F.col("month") < F.add_months("Ti", -end)) & (F.col("month") >= F.add_months("Ti", -start)))
        prof = (build_calendar_profiles(own, calendar_months, calendar_years) if kind == "calendar"
                else build_summary_profiles(own, all_vars))
        tags = F.create_map(*[F.lit(x) for check, cols in checks for c in cols for x in (c, check)])
        parts.append(balance_scopes(prof, [c for _, cols in checks for c in cols]).select(
            tags[F.col("covariate")].alias("check"), F.lit(start).alias("window_start"), F.lit(end).alias("window_end"),
            "scope", "Ti", "covariate", "treated_mean", "control_mean", "SMD"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def calendar_valid_dim_distribution(
    matches: DataFrame, base: DataFrame, start_month: int = 24, end_month: int = 0,
    months: Sequence[int] = (1, 2, 3, 11, 12), years: int = 2,
) -> DataFrame:
    """V4: distribution of non-missing calendar features among matched units."""
    rows = validation_rows(matched_ids(matches), base, start_month, end_month)
    cal = build_calendar_profiles(rows, months, years)
    cols = calendar_feature_names(months, years, detect_price_suffixes(base.columns))
    valid = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    return cal.withColumn("valid_dim", valid).groupBy("valid_dim").agg(F.count(F.lit(1)).alias("count")).orderBy("valid_dim")
