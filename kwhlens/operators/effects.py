"""Treatment effects from matched panels.

Effects come from a table of moments (n, mean, M2 of each side) per event time and
cohort, one ``groupBy`` over the panel.  Moments merge, so the overall effects, the
cohorts' effects, the pre-trend test and the ATTs all derive from one such table.
p-values are column expressions (``kwhlens.functions.stats``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kwhlens.functions.stats import Z_975, normal_two_sided_p, safe_div, t_two_sided_p
from kwhlens.session import Scratch

OUTCOME = "top3_mean_consumption"
ATT_Z = 1.96


def _t_and_p(effect, se):
    t = F.when(se > 0, effect / se)
    return t, F.when(se > 0, normal_two_sided_p(t))


def _moments(value, name: str) -> list:
    """Count, mean and M2 of a value, NULLs left out."""
    n = F.count(value)
    return [n.alias(f"n_{name}"), F.avg(value).alias(f"mean_{name}"), (F.var_pop(value) * n).alias(f"m2_{name}")]


def group_moments(panel: DataFrame, outcome_col: str = OUTCOME, keys: Sequence[str] = ("cohort", "event_time")) -> DataFrame:
    """Per key: rows of treated and control units, and the moments of their outcomes, in one pass."""
    y = F.col(outcome_col)
    tr, co = F.col("treatment") == 1, F.col("treatment") == 0
    return panel.where(F.col("event_time").isNotNull()).groupBy(*keys).agg(
        F.count(F.when(tr, 1)).alias("n_treated"), F.count(F.when(co, 1)).alias("n_control"),
        *_moments(F.when(tr, y), "t"), *_moments(F.when(co, y), "c"))


def pair_moments(pairs: DataFrame, keys: Sequence[str] = ("cohort", "event_time")) -> DataFrame:
    """Per key: pairs with an effect, their controls, and the moments of both sides and of the effect."""
    known = F.col("event_time").isNotNull() & F.col("pair_effect").isNotNull()
    return pairs.where(known).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_treated"), F.sum("n_controls").alias("n_control"),
        *_moments(F.col("treated_y"), "t"), *_moments(F.col("matched_control_y"), "c"), *_moments(F.col("pair_effect"), "e"))


def merge_moments(moments: DataFrame, keys: Sequence[str] = ("event_time",)) -> DataFrame:
    """Moments of coarser keys (parallel variance merge around the common mean)."""
    sides = [c.removeprefix("m2_") for c in moments.columns if c.startswith("m2_")]
    whole = Window.partitionBy(*keys)
    around = moments.withColumns({
        f"_all_{s}": F.sum(F.col(f"n_{s}") * F.col(f"mean_{s}")).over(whole) / F.nullif(F.sum(f"n_{s}").over(whole), F.lit(0))
        for s in sides})
    return around.groupBy(*keys).agg(
        F.sum("n_treated").alias("n_treated"), F.sum("n_control").alias("n_control"),
        *[c for s in sides for c in (
            F.sum(f"n_{s}").alias(f"n_{s}"), F.max(f"_all_{s}").alias(f"mean_{s}"),
            F.sum(F.col(f"m2_{s}") + F.col(f"n_{s}") * F.pow(F.col(f"mean_{s}") - F.col(f"_all_{s}"), 2)).alias(f"m2_{s}"))])


def _variance(side: str):
    n = F.col(f"n_{side}")
    return F.when(n > 1, F.col(f"m2_{side}") / (n - 1))


def group_effects(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Treated − control mean with Welch standard error and normal p, from moments per key.

    ``n_treated`` / ``n_control`` count rows including missing outcomes, and both must be >= 2.
    """
    g = moments.where((F.col("n_treated") >= 2) & (F.col("n_control") >= 2)).withColumnsRenamed(
        {"mean_t": "mean_treated", "mean_c": "mean_control"})
    g = g.withColumn("effect", F.col("mean_treated") - F.col("mean_control"))
    g = g.withColumn("se", F.sqrt(_variance("t") / F.col("n_treated") + _variance("c") / F.col("n_control")))
    t, p = _t_and_p(F.col("effect"), F.col("se"))
    g = g.withColumn("t_stat", t).withColumn("p_value", p)
    head = list(keys) + ([] if "cohort" in keys else ["mean_treated", "mean_control"])
    return g.select(*head, "effect", "se", "t_stat", "p_value", "n_treated", "n_control")


def pair_effects(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean pair effect, se = sd/√n, from moments per key; n >= 2 required."""
    g = moments.where(F.col("n_treated") >= 2).withColumnsRenamed(
        {"mean_t": "mean_treated", "mean_c": "mean_control", "mean_e": "effect"})
    g = g.withColumn("se", F.sqrt(_variance("e")) / F.sqrt(F.col("n_treated")))
    t, p = _t_and_p(F.col("effect"), F.col("se"))
    g = g.withColumn("t_stat", t).withColumn("p_value", p)
    return g.select(*keys, "mean_treated", "mean_control", "effect", "se", "t_stat", "p_value", "n_treated", "n_control")


def compute_effect(panel: DataFrame, outcome_col: str = OUTCOME, by_cohort: bool = False) -> DataFrame:
    """Treated − control mean per event time (and cohort), see ``group_effects``."""
    keys = (["cohort"] if by_cohort else []) + ["event_time"]
    return group_effects(group_moments(panel, outcome_col, keys), keys)


def compute_pair_effect(pairs: DataFrame, by_cohort: bool = False) -> DataFrame:
    """Mean pair effect per event time (and cohort) over non-missing pairs, see ``pair_effects``."""
    keys = (["cohort"] if by_cohort else []) + ["event_time"]
    return pair_effects(pair_moments(pairs, keys), keys)


def add_confidence_interval(effects: DataFrame, alpha: float = 0.05) -> DataFrame:
    """E5: effect ± z(1−α/2)·se."""
    from statistics import NormalDist

    z = Z_975 if alpha == 0.05 else NormalDist().inv_cdf(1 - alpha / 2)
    return effects.withColumn("ci_low", F.col("effect") - z * F.col("se")).withColumn(
        "ci_high", F.col("effect") + z * F.col("se")
    )


def _mean_test(effects: DataFrame, keys: Sequence[str]):
    e = F.col("effect")
    return effects.where(e.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_periods"), F.avg(e).alias("_m"), F.stddev_samp(e).alias("_sd")
    )


def pretrend_test(effects: DataFrame, pre_start: int = -12, pre_end: int = -1) -> DataFrame:
    """One-sample t-test of pre-period effects against 0 (Student t, n−1 df).

    Always one row; fewer than two periods → NULL statistics.
    """
    pre = effects.where(F.col("event_time").between(pre_start, pre_end))
    g = _mean_test(pre, [])
    ok = F.col("n_periods") >= 2
    t = safe_div(F.col("_m"), F.col("_sd") / F.sqrt(F.col("n_periods")))
    return g.select(
        F.lit(pre_start).alias("pre_start"),
        F.lit(pre_end).alias("pre_end"),
        "n_periods",
        F.when(ok, F.col("_m")).alias("mean_pre_effect"),
        F.when(ok, t).alias("t_stat"),
        F.when(ok, t_two_sided_p(t, F.col("n_periods") - 1)).alias("p_value"),
    )


def _att_cols(ok):
    att = F.col("_m")
    se = F.col("_sd") / F.sqrt(F.col("n_periods"))
    t = F.when(se > 0, att / se)
    return [
        F.when(ok, att).alias("ATT"),
        F.when(ok, se).alias("SE"),
        F.when(ok, t).alias("t_stat"),
        F.when(ok & (se > 0), normal_two_sided_p(t)).alias("p_value"),
        F.when(ok, att - ATT_Z * se).alias("CI_low"),
        F.when(ok, att + ATT_Z * se).alias("CI_high"),
        "n_periods",
    ]


def _post(effects: DataFrame, post_period_only: bool, max_post_periods: int | None) -> DataFrame:
    if post_period_only:
        effects = effects.where(F.col("event_time") >= 0)
    if max_post_periods is not None:
        effects = effects.where(F.col("event_time") < max_post_periods)
    return effects


def average_treatment_effect(effects: DataFrame, post_period_only: bool = True,
                             max_post_periods: int | None = None) -> DataFrame:
    """Mean of period effects, se = sd/√n, normal p, ±1.96·se (one row)."""
    g = _mean_test(_post(effects, post_period_only, max_post_periods), [])
    return g.select(*_att_cols(F.col("n_periods") >= 2))


def att_by_cohort(effects: DataFrame, post_period_only: bool = True,
                  max_post_periods: int | None = None) -> DataFrame:
    """E7 per cohort; cohorts with fewer than two periods are dropped."""
    g = _mean_test(_post(effects, post_period_only, max_post_periods), ["cohort"])
    return g.where(F.col("n_periods") >= 2).select("cohort", *_att_cols(F.lit(True)))


def run_full_analysis(panel: DataFrame, outcome_col: str = OUTCOME, pre_start: int = -12,
                      pre_end: int = -1, pairs: bool = False) -> dict[str, DataFrame]:
    """Dynamic effects (overall, by cohort), pre-trend test, ATT over all
    post periods and the first three, per cohort too.

    The panel is read once: the moments per cohort and event time (bounded by the calendar) are written as
    a table, from which all results derive.  ``pairs=True`` takes a pair panel (M2) and uses pair-level effects.
    """
    moments = Scratch(panel.sparkSession, "effects").table(
        pair_moments(panel) if pairs else group_moments(panel, outcome_col), "moments")
    of = pair_effects if pairs else group_effects
    overall = add_confidence_interval(of(merge_moments(moments), ["event_time"]))
    cohort = add_confidence_interval(of(moments, ["cohort", "event_time"]))
    out = {
        "overall": overall,
        "cohort": cohort,
        "pretrend": pretrend_test(overall, pre_start, pre_end),
        "att_all": average_treatment_effect(overall),
        "att_3m": average_treatment_effect(overall, max_post_periods=3),
        "att_by_cohort_all": att_by_cohort(cohort),
        "att_by_cohort_3m": att_by_cohort(cohort, max_post_periods=3),
    }
    if pairs:
        out["pair_effect_hist"] = pair_effect_histogram(panel)
    return out


# File names of the saved result tables, and the result each holds.
GROUP_RESULT_NAMES = {
    "overall_dynamic": "overall", "cohort_dynamic": "cohort", "att_overall": "att_all",
    "att_by_cohort": "att_by_cohort_all", "pretrend_test": "pretrend", "att_overall_all_post": "att_all",
    "att_overall_first_3m": "att_3m", "att_by_cohort_all_post": "att_by_cohort_all",
    "att_by_cohort_first_3m": "att_by_cohort_3m",
}
PAIR_RESULT_NAMES = {
    "overall_pair_dynamic": "overall", "cohort_pair_dynamic": "cohort", "pretrend_test": "pretrend",
    "att_overall_all_post": "att_all", "att_overall_first_3m": "att_3m",
    "att_by_cohort_all_post": "att_by_cohort_all", "att_by_cohort_first_3m": "att_by_cohort_3m",
}


def named_results(results: dict[str, DataFrame], pairs: bool = False) -> dict[str, DataFrame]:
    """The nine group-mean or seven pair-level tables under the names they are saved by."""
    return {name: results[key] for name, key in (PAIR_RESULT_NAMES if pairs else GROUP_RESULT_NAMES).items()}


def histogram(df: DataFrame, value_col: str, keys: Sequence[str], bins: int) -> DataFrame:
    """Equal-width histogram per key group, numpy semantics: range [min, max]
    (±0.5 when constant), last bin closed, every bin reported (zero-filled).

    Bin index = floor((x − lo)·bins/(hi − lo)) corrected against the bin edges
    ``lo + i·(hi − lo)/bins`` exactly like numpy does.
    """
    x = F.col(value_col)
    rng = (
        df.where(x.isNotNull())
        .groupBy(*keys)
        .agg(F.min(x).alias("_mn"), F.max(x).alias("_mx"), F.avg(x).alias("mean"), F.count(F.lit(1)).alias("n"))
        .withColumn("_lo", F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")))
        .withColumn("_hi", F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")))
    )
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))

    def edge(i):
        return F.when(i == bins, F.col("_hi")).otherwise(F.col("_lo") + i * step)

    # range rows are one per key group (bounded by the keys), broadcast back
    j = df.where(x.isNotNull()).select(*keys, x.alias("_x")).join(F.broadcast(rng), list(keys))
    idx = F.floor((F.col("_x") - F.col("_lo")) * (F.lit(float(bins)) / (F.col("_hi") - F.col("_lo")))).cast("int")
    idx = F.when(idx >= bins, bins - 1).otherwise(idx)
    j = j.withColumn("_i", idx)
    j = j.withColumn("_i", F.when(F.col("_x") < edge(F.col("_i")), F.col("_i") - 1).otherwise(F.col("_i")))
    j = j.withColumn(
        "_i",
        F.when((F.col("_x") >= edge(F.col("_i") + 1)) & (F.col("_i") != bins - 1), F.col("_i") + 1).otherwise(F.col("_i")),
    )
    counts = j.groupBy(*keys, F.col("_i").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = rng.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return (
        grid.join(counts, [*keys, "bin"], "left")
        .select(
            *keys, "bin",
            edge(F.col("bin")).alias("bin_low"),
            edge(F.col("bin") + 1).alias("bin_high"),
            F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
            "mean",
        )
    )


def pair_effect_histogram(pairs: DataFrame, event_times: Sequence[int] = (-1, 0, 1, 2),
                          bins: int = 40) -> DataFrame:
    """Distribution of pair effects at selected event times (+ their mean)."""
    sel = pairs.where(F.col("event_time").isin(list(event_times)))
    return histogram(sel, "pair_effect", ["event_time"], bins)

