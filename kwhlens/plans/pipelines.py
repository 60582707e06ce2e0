"""Matching pipelines (L1–L4) and the named run configurations of the analyses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kwhlens.operators import balance as B
from kwhlens.operators import matching as N
from kwhlens.operators import profiles as Fp
from kwhlens.operators.panel import prepare_matching_data
from kwhlens.session import Scratch, materialize
from kwhlens.sources.sinks import save_matching_outputs

CALENDAR_MONTHS = (1, 2, 3, 11, 12)
SUMMARY_4 = ["peak_mean", "peak_sd", "peak_volatility", "mean_consumption", "variance_consumption", "trend"]


def _finish(risk_rows, profiles_z, matches, match_vars, persist):
    matches = materialize(matches, persist)
    matched = N.build_matched_profiles(profiles_z, matches)
    return {
        "risk_rows": risk_rows,
        "profiles": profiles_z,
        "matches": matches,
        "matched_profiles": matched,
        "balance": B.balance_table(matched, match_vars, pool=True),
        "balance_by_ti": B.balance_table(matched, match_vars, pool=False),
        "match_vars": list(match_vars),
    }


def run_summary_matching(
    risk_rows: DataFrame,
    k_neighbors: int = 5,
    blocking_threshold: float = 0.3,
    summary_vars: Sequence[str] | None = None,
    rows_per_salt: int = N.ROWS_PER_SALT,
    persist: str = "table",
) -> dict:
    """L1: summary features → z-scores → blocked kNN → matched profiles → balance.

    Default features per price: peak_mean, mean_consumption, peak_sd, trend;
    blocking on the first ``peak_mean*`` feature.  ``persist`` cuts lineage at
    the z-scored profiles and the matches, which the balance tables reuse (by
    default as tables in the shared folder; ``none`` keeps one lazy plan).
    """
    sfx = Fp.detect_price_suffixes(risk_rows.columns)
    if summary_vars is None:
        base = ["peak_mean", "mean_consumption", "peak_sd", "trend"]
        summary_vars = base if sfx == [""] else [f"{v}_{s}" for s in sfx for v in base]
    summary_vars = list(summary_vars)
    prof = Fp.build_summary_profiles(risk_rows, summary_vars)
    pz = materialize(Fp.standardize_by_control(prof, summary_vars), persist)
    block = "peak_mean"
    if block not in summary_vars:
        cands = [v for v in summary_vars if v.startswith("peak_mean_")]
        block = cands[0] if cands else "peak_mean"
    matches = N.match_topk(pz, summary_vars, k_neighbors, blocking_threshold,
                           use_peak_blocking=block in summary_vars, peak_block_col=block, rows_per_salt=rows_per_salt)
    return _finish(risk_rows, pz, matches, summary_vars, persist)


def run_time_series_matching(
    risk_rows: DataFrame,
    lookback_months: int = 12,
    k_neighbors: int = 5,
    rows_per_salt: int = N.ROWS_PER_SALT,
    persist: str = "table",
) -> dict:
    """L2: lag profile ``peak_lag_1..L`` → z-scores → missing-aware kNN."""
    cols = [f"peak_lag_{i}" for i in range(1, lookback_months + 1)]
    pz = materialize(Fp.standardize_by_control(Fp.build_lag_profiles(risk_rows, lookback_months), cols), persist)
    matches = N.match_topk_allow_missing(pz, cols, k_neighbors, rows_per_salt=rows_per_salt)
    return _finish(risk_rows, pz, matches, cols, persist)


def run_calendar_matching(
    risk_rows: DataFrame,
    lookback_years: int = 2,
    match_months: Sequence[int] = CALENDAR_MONTHS,
    k_neighbors: int = 5,
    rows_per_salt: int = N.ROWS_PER_SALT,
    persist: str = "table",
) -> dict:
    """L3: calendar-aligned profile → z-scores → missing-aware kNN."""
    prof = Fp.build_calendar_profiles(risk_rows, match_months, lookback_years)
    cols = Fp.calendar_feature_names(match_months, lookback_years, Fp.detect_price_suffixes(risk_rows.columns))
    pz = materialize(Fp.standardize_by_control(prof, cols), persist)
    matches = N.match_topk_allow_missing(pz, cols, k_neighbors, rows_per_salt=rows_per_salt)
    return _finish(risk_rows, pz, matches, cols, persist)


def save_run(res: dict, folder: str, config: dict) -> None:
    """L4: matches, matched profiles, pooled balance and the configuration."""
    save_matching_outputs(res["matches"], res["matched_profiles"], res["balance"], config, folder)


# Named configurations of the reference analyses:
# name -> (risk-set arguments, pipeline, pipeline arguments)
RUN_CONFIGS = {
    "all/time_series": (dict(lookback_months=12), "time_series", dict(lookback_months=12)),
    "all/calendar": (dict(lookback_months=24), "calendar", dict(lookback_years=2, k_neighbors=5)),
    "all/calendar_1year": (dict(lookback_months=12), "calendar", dict(lookback_years=1, k_neighbors=5)),
    "all/calendar2": (dict(lookback_months=24), "calendar", dict(lookback_years=2, k_neighbors=3)),
    "all/summary_4": (dict(lookback_months=12), "summary", dict(summary_vars=SUMMARY_4)),
    "all/summary_season2": (dict(lookback_months=24, match_months=list(CALENDAR_MONTHS)), "summary",
                            dict(summary_vars=SUMMARY_4)),
    "high/calendar2": (dict(lookback_months=24, price_value="high"), "calendar",
                       dict(lookback_years=2, k_neighbors=5)),
    "high/calendar2_1year": (dict(lookback_months=12, price_value="high"), "calendar",
                             dict(lookback_years=1, k_neighbors=5)),
    "high/summary_4": (dict(lookback_months=12, price_value="high"), "summary", dict(summary_vars=SUMMARY_4)),
    "all+high/calendar2": (dict(lookback_months=24, price_values=["high", "all"]), "calendar",
                           dict(lookback_years=2, k_neighbors=5)),
    "all+high/calendar2_1year": (dict(lookback_months=12, price_values=["high", "all"]), "calendar",
                                 dict(lookback_years=1, k_neighbors=5)),
    "all+high/summary_4": (dict(lookback_months=12, price_values=["high", "all"]), "summary",
                           dict(summary_vars=[f"{v}_{p}" for p in ("high", "all") for v in SUMMARY_4])),
    "all+high/calendar2_1year_k3": (dict(lookback_months=12, price_values=["high", "all"]), "calendar",
                                    dict(lookback_years=1, k_neighbors=3)),
}


def _risk_arguments(name: str, control_type: str) -> dict:
    """Arguments of ``prepare_matching_data`` of a named run."""
    kw = dict(RUN_CONFIGS[name][0], control_type=control_type)
    if name.startswith("all/"):
        kw["price_value"] = "all"
    return kw


def _run_on(risk: DataFrame, name: str, **kw) -> dict:
    _, kind, p_kw = RUN_CONFIGS[name]
    pipeline = {"summary": run_summary_matching, "time_series": run_time_series_matching,
                "calendar": run_calendar_matching}[kind]
    return pipeline(risk, **{**p_kw, **kw})


def run_named(month_result: DataFrame, name: str, control_type: str = "never_treated", **kw) -> dict:
    """Run one named configuration end to end from the monthly table."""
    return _run_on(prepare_matching_data(month_result, **_risk_arguments(name, control_type)), name, **kw)


def run_batch(month_result: DataFrame, names: Sequence[str] | None = None, control_type: str = "never_treated",
              **kw) -> dict[str, dict]:
    """Several named configurations (all by default), each distinct risk set built and written once.

    The monthly table is written once as well; the results are those of ``run_named`` by name.
    """
    scratch = Scratch(month_result.sparkSession, "runs")
    month = scratch.table(month_result, "month")
    risks: dict[str, DataFrame] = {}
    out = {}
    for name in names or RUN_CONFIGS:
        arguments = _risk_arguments(name, control_type)
        key = repr(sorted(arguments.items()))
        if key not in risks:
            risks[key] = scratch.table(prepare_matching_data(month, **arguments), f"risk-{len(risks)}")
        out[name] = _run_on(risks[key], name, **kw)
    return out


def tagged_matches(runs: dict[str, dict]) -> DataFrame:
    """The matches of several runs in one table: ``run``, the columns of N1, and ``valid_dim`` (NULL for summary runs)."""
    parts = []
    for name, result in runs.items():
        m = result["matches"]
        dim = F.col("valid_dim") if "valid_dim" in m.columns else F.lit(None).cast("int").alias("valid_dim")
        parts.append(m.select(F.lit(name).alias("run"), "treated_id", "control_id", "adoption_month", "distance", dim,
                              "match_rank"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
