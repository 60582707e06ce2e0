"""Chart-ready descriptive datasets (C1–C8, T1–T4, K1–K8), always in long form.

Drawing is left to the caller; these functions produce the tables behind the
charts.  Zero-filled grids are generated from bounded key sets (months ×
24 hours, the month range of the contracts, the cohorts asked for) and joined
with a broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kwhlens.functions.dates import month_label, month_start, months_between_periods
from kwhlens.functions.quantiles import exact_quantiles
from kwhlens.operators.effects import histogram
from kwhlens.operators.readings import PLAN_GROUP_PATTERN, PLAN_PATTERN, normalize_tariff, plan_label

USAGE_ORDER = ("low", "medium", "high")
_AGGS = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "median": F.median, "count": F.count}


def _agg(agg: str, col: str):
    if agg not in _AGGS:
        raise ValueError(f"unknown aggregation: {agg}")
    return _AGGS[agg](F.col(col))


# --------------------------------------------------------------------------- C
def consumption_profile(
    df: DataFrame,
    value_col: str,
    agg: str = "mean",
    splits: Sequence[str] | None = None,
    exclude_future_tariff: bool = False,
    facet_by: str | None = None,
) -> DataFrame:
    """``agg(value)`` by period (``TIDPUNKT``) × splits (× facet).

    With a ``price`` split the 'all' rows are dropped; ``exclude_future_tariff``
    (with a ``tariff_active`` split) keeps active adopters and never-adopters
    only.
    """
    splits = list(splits or [])
    data = df
    if exclude_future_tariff and "tariff_active" in splits:
        data = data.where((F.col("tariff_active") == 1) | F.col("tariff_start").isNull())
    if "price" in splits:
        data = data.where(F.col("price") != "all")
    keys = ["TIDPUNKT", *splits, *([facet_by] if facet_by else [])]
    return data.groupBy(*keys).agg(_agg(agg, value_col).alias(value_col))


def adopter_profile(df: DataFrame, value_col: str = "top3_mean_consumption", by_price: bool = False,
                    agg: str = "mean") -> DataFrame:
    """Adopters vs. non-adopters (``has_tariff``), optionally by price."""
    data = df.withColumn("has_tariff", F.col("tariff_start").isNotNull().cast("int"))
    return consumption_profile(data, value_col, agg, ["price", "has_tariff"] if by_price else ["has_tariff"])


def adoption_by_usage(df: DataFrame) -> DataFrame:
    """C4: share of rows with an active tariff per usage group (low/medium/high,
    missing groups kept with NULL share)."""
    share = df.groupBy("usage_group").agg(F.avg("tariff_active").alias("share_active"))
    order = df.sparkSession.createDataFrame([(g, i) for i, g in enumerate(USAGE_ORDER)], "usage_group string, order int")
    return order.join(share, "usage_group", "left").select("usage_group", "share_active", "order")


def descriptive_event_study(df: DataFrame, value_col: str = "mean_consumption",
                            line_cols: Sequence[str] | str | None = None, window: int = 6) -> DataFrame:
    """Adopters only, months relative to the tariff start within ±window."""
    if isinstance(line_cols, str):
        line_cols = [line_cols]
    line_cols = list(line_cols or [])
    data = df.where(F.col("tariff_start").isNotNull()).withColumn(
        "event_time", months_between_periods("TIDPUNKT", "tariff_start")
    )
    data = data.where(F.col("event_time").between(-window, window))
    return data.groupBy("event_time", *line_cols).agg(F.avg(value_col).alias(value_col))


def _tariff_month(df: DataFrame):
    return month_start("tariff_start")


def cohort_calendar(df: DataFrame, cohort_month: str, value_col: str = "top3_mean_consumption") -> DataFrame:
    """Cohort adopters ('treated') vs. never-adopters ('control') per calendar month."""
    c = F.lit(f"{cohort_month}-01").cast("date")
    tm = _tariff_month(df)
    data = df.withColumn(
        "group", F.when(tm == c, "treated").when(F.col("tariff_start").isNull(), "control")
    ).where(F.col("group").isNotNull())
    return data.groupBy(month_start("TIDPUNKT").alias("TIDPUNKT"), "group").agg(F.avg(value_col).alias(value_col))


def cohort_multi(df: DataFrame, cohort_months: Sequence[str], value_col: str = "top3_mean_consumption",
                 include_control: bool = True) -> DataFrame:
    """Several cohorts (group = 'YYYY-MM') and optionally never-adopters ('control')."""
    tm = month_label(_tariff_month(df))
    grp = F.when(tm.isin(list(cohort_months)), tm)
    if include_control:
        grp = grp.when(F.col("tariff_start").isNull(), F.lit("control"))
    data = df.withColumn("group", grp).where(F.col("group").isNotNull())
    return data.groupBy(month_start("TIDPUNKT").alias("TIDPUNKT"), "group").agg(F.avg(value_col).alias(value_col))


def cohort_panels(df: DataFrame, cohort_months: Sequence[str], mode: str = "raw",
                  value_col: str = "top3_mean_consumption") -> DataFrame:
    """Per cohort, treated vs. control mean per month (long: cohort, TIDPUNKT, group, value).

    ``raw``: cohort adopters vs. never-adopters; the never-adopters' months are
    averaged once and the averages are listed for every requested cohort;
    ``matched``: a matched panel with ``cohort`` and ``treatment`` columns.
    """
    month = month_start("TIDPUNKT").alias("TIDPUNKT")
    mean = F.avg(value_col).alias(value_col)
    wanted = F.array(*[F.lit(m) for m in sorted(set(cohort_months))])
    if mode == "raw":
        label = month_label(_tariff_month(df))
        treated = df.where(label.isin(list(cohort_months))).groupBy(
            label.alias("cohort"), month).agg(mean).withColumn("group", F.lit("treated"))
        control = df.where(F.col("tariff_start").isNull()).groupBy(month).agg(mean).withColumn(
            "group", F.lit("control")).withColumn("cohort", F.explode(wanted))
        return treated.unionByName(control).select("cohort", "TIDPUNKT", "group", value_col)
    if mode == "matched":
        role = F.when(F.col("treatment") == 1, "treated").when(F.col("treatment") == 0, "control")
        data = df.withColumn("cohort", month_label("cohort")).where(F.array_contains(wanted, F.col("cohort")))
        return data.where(role.isNotNull()).groupBy("cohort", month, role.alias("group")).agg(mean)
    raise ValueError(f"unknown mode {mode!r}: raw and matched are known")


# --------------------------------------------------------------------------- T
def adoption_monthly(tariff: DataFrame) -> DataFrame:
    """Distinct households per contract start month."""
    t = normalize_tariff(tariff)
    return t.groupBy(month_start("tariff_start").alias("month")).agg(
        F.count_distinct("aID").alias("n_households")).withColumn("label", month_label("month"))


def _month_grid(monthly: DataFrame) -> DataFrame:
    """All months between the first and last month of ``monthly`` (one row each)."""
    bounds = monthly.agg(F.min("month").alias("_lo"), F.max("month").alias("_hi"))
    return bounds.select(F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 MONTH"))).alias("month"))


def adoption_share(tariff: DataFrame, total_households) -> DataFrame:
    """Cumulative adopters / total households, gap-filled month by month.

    ``total_households``: a number or a DataFrame of households (distinct
    ``aID`` is counted as a one-row aggregate).
    """
    monthly = adoption_monthly(tariff)
    grid = _month_grid(monthly)
    filled = grid.join(monthly.select("month", "n_households"), "month", "left").withColumn(
        "n_households", F.coalesce("n_households", F.lit(0)))
    if isinstance(total_households, DataFrame):
        tot = total_households.agg(F.count_distinct("aID").alias("_tot"))
    else:
        tot = tariff.sparkSession.createDataFrame([(float(total_households),)], "_tot double")
    w = "month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    cum = F.expr(f"sum(n_households) OVER (ORDER BY {w})")
    return filled.crossJoin(F.broadcast(tot)).select(
        "month", "n_households", cum.alias("cumulative"), (cum / F.col("_tot")).alias("share"))


def plan_counts(tariff: DataFrame) -> DataFrame:
    """Contract rows per plan group (``\\d+ kW <word>``), most frequent first."""
    t = normalize_tariff(tariff).withColumn("tariff_group", plan_label("tariff_plan", PLAN_GROUP_PATTERN))
    return (t.where(F.col("tariff_group").isNotNull()).groupBy("tariff_group")
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "tariff_group"))


def plan_cumulative(tariff: DataFrame) -> DataFrame:
    """T4: cumulative distinct adopters per plan (Villa / Normal), gap-filled months × plans."""
    t = normalize_tariff(tariff).withColumn("plan", plan_label("tariff_plan", PLAN_PATTERN)).where(
        F.col("plan").isNotNull())
    monthly = t.groupBy(month_start("tariff_start").alias("month"), "plan").agg(
        F.count_distinct("aID").alias("n_households"))
    grid = _month_grid(monthly).crossJoin(monthly.select("plan").distinct())
    filled = grid.join(monthly, ["month", "plan"], "left").withColumn(
        "n_households", F.coalesce("n_households", F.lit(0)))
    cum = F.expr("sum(n_households) OVER (PARTITION BY plan ORDER BY month "
                 "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    return filled.select("month", "plan", "n_households", cum.alias("cumulative"))


# --------------------------------------------------------------------------- K
def peaks_long(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """K1: peak1..3 → rows (time, consumption, peak_rank), missing dropped, month and hour added."""
    rows = F.explode(F.array(*[
        F.struct(F.col(f"peak{i}_time").alias("time"),
                 F.col(f"peak{i}_consumption").cast("double").alias("consumption"),
                 F.lit(i).alias("peak_rank"))
        for i in (1, 2, 3)
    ])).alias("_p")
    out = df.select(*keep, rows).select(*keep, "_p.*").where(F.col("time").isNotNull() & F.col("consumption").isNotNull())
    return out.withColumn("month", F.month("time")).withColumn("hour", F.hour("time"))


def _mode_value(mode: str):
    if mode == "count":
        return F.count(F.lit(1)).cast("double")
    if mode == "consumption":
        return F.sum("consumption")
    raise ValueError(f"peaks are counted (count) or summed (consumption), not {mode!r}")


def peak_hours(df: DataFrame, mode: str = "count") -> DataFrame:
    """K2: peak count (or summed peak kWh) per hour of day."""
    v = _mode_value(mode)
    return peaks_long(df).groupBy("hour").agg(v.alias("value"))


def _grid(spark, months: Sequence[int] = range(1, 13)) -> DataFrame:
    return spark.createDataFrame([(m, h) for m in months for h in range(24)], "month int, hour int")


def peak_heatmap(df: DataFrame, mode: str = "count") -> DataFrame:
    """K3: month × hour, zero-filled 12 × 24."""
    v = _mode_value(mode)
    cells = peaks_long(df).groupBy("month", "hour").agg(v.alias("value"))
    return _grid(df.sparkSession).join(cells, ["month", "hour"], "left").withColumn(
        "value", F.coalesce("value", F.lit(0.0)))


def peak_hist(df: DataFrame, bins: int = 30) -> DataFrame:
    """K4: histogram of peak consumption (numpy bins: max falls in the last bin)."""
    p = peaks_long(df).withColumn("_all", F.lit(1))
    return histogram(p, "consumption", ["_all"], bins).drop("_all")


def peak_box(df: DataFrame, exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """K5: box statistics per peak rank; whiskers = furthest points within 1.5·IQR.

    Quartiles are interpolated linearly, exactly by counted bins;
    ``exact=False`` takes them from a sketch instead.
    """
    p = peaks_long(df)
    x, quarters = F.col("consumption"), [0.25, 0.5, 0.75]
    if exact:
        qs = exact_quantiles(p, ["peak_rank"], "consumption", quarters, interpolate=True).select(
            "peak_rank", "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    else:
        qs = p.groupBy("peak_rank").agg(
            F.percentile_approx(x, quarters, accuracy).alias("_q"), F.count(F.lit(1)).alias("n")).select(
            "peak_rank", "n", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    qs = qs.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo = F.col("q1") - 1.5 * F.col("iqr")
    hi = F.col("q3") + 1.5 * F.col("iqr")
    # three rows (one per rank): broadcast back to the peaks
    wh = p.join(F.broadcast(qs), "peak_rank").groupBy("peak_rank").agg(
        F.min(F.when(x >= lo, x)).alias("whisker_low"), F.max(F.when(x <= hi, x)).alias("whisker_high"))
    return qs.join(wh, "peak_rank")


SEGMENTS = ("never", "before", "after")


def _segment(df: DataFrame) -> DataFrame:
    seg = (F.when(F.col("tariff_start").isNull(), "never")
           .when(F.col("tariff_active") == 1, "after")
           .when(F.col("tariff_active") == 0, "before"))
    return df.withColumn("segment", seg).where(F.col("segment").isNotNull())


def segment_heatmap(df: DataFrame, agg: str = "count") -> DataFrame:
    """K6–K7: month × hour per segment (never / before / after adoption) and
    ``diff`` = after − before.

    Months: union of months with peaks in any segment; hours 0..23.
    ``count`` and ``sum`` are zero-filled, ``mean`` leaves empty cells NULL.
    """
    made = {"count": F.count(F.lit(1)).cast("double"), "sum": F.sum("consumption"), "mean": F.avg("consumption")}
    if agg not in made:
        raise ValueError(f"agg must be one of {sorted(made)}, not {agg!r}")
    cells = peaks_long(_segment(df), keep=["segment"]).groupBy("month", "hour", "segment").agg(made[agg].alias("v"))
    # one row per month and hour with the value of each segment: at most 12 x 24 rows from here on
    wide = cells.groupBy("month").agg(F.map_from_entries(F.collect_list(F.struct(
        F.struct("segment", "hour").alias("cell"), "v"))).alias("cells"))

    def value(segment: str, hour: Column) -> Column:
        v = F.try_element_at("cells", F.struct(F.lit(segment).alias("segment"), hour.alias("hour")))
        return v if agg == "mean" else F.coalesce(v, F.lit(0.0))

    hours = wide.select("month", "cells", F.explode(F.array(*[F.lit(h) for h in range(24)])).alias("hour"))
    parts = [F.struct(F.lit(s).alias("segment"), value(s, F.col("hour")).alias("value")) for s in SEGMENTS]
    parts.append(F.struct(F.lit("diff").alias("segment"),
                          (value("after", F.col("hour")) - value("before", F.col("hour"))).alias("value")))
    return hours.select("month", "hour", F.explode(F.array(*parts)).alias("p")).select(
        "p.segment", "month", "hour", "p.value")


def scale_limits(seg: DataFrame) -> DataFrame:
    """K8: colour-scale limits: max over never, max over before/after, max |diff| (0 when empty)."""
    v = F.col("value")
    s = F.col("segment")
    return seg.agg(
        F.coalesce(F.max(F.when(s == "never", v)), F.lit(0.0)).alias("vmax_never"),
        F.coalesce(F.max(F.when(s.isin("before", "after"), v)), F.lit(0.0)).alias("vmax_adopters"),
        F.coalesce(F.max(F.when(s == "diff", F.abs(v))), F.lit(0.0)).alias("diff_abs_max"),
    )
