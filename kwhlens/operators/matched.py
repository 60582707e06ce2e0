"""Matched panels: matches × monthly results (M1–M3).

``cohort`` is the adoption month (DATE, first of month); ``event_time`` is the
difference in calendar months between the row's month and the cohort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kwhlens.functions.dates import month_label, month_start, months_between_periods
from kwhlens.functions.stats import null_if_nan

OUTCOME = "top3_mean_consumption"


def _numeric(df: DataFrame, c: str):
    dt = df.schema[c].dataType
    col = F.col(c).try_cast("double") if isinstance(dt, T.StringType) else F.col(c).cast("double")
    return null_if_nan(col)


def with_cohort(matches: DataFrame) -> DataFrame:
    return matches.withColumn("cohort", month_start("adoption_month"))


def unweighted_panel(matches: DataFrame, month_result: DataFrame, outcome_col: str = OUTCOME) -> DataFrame:
    """M1: distinct treated (treatment 1) ∪ every control edge (treatment 0; a
    control matched to several treated units appears once per edge) joined to
    the monthly rows on ``aID``."""
    m = with_cohort(matches)
    tr = m.select(F.col("treated_id").alias("aID"), "cohort").distinct().withColumn("treatment", F.lit(1))
    co = m.select(F.col("control_id").alias("aID"), "cohort").withColumn("treatment", F.lit(0))
    df = month_result.join(tr.unionByName(co), "aID", "inner")
    return df.withColumns(
        {
            "TIDPUNKT": month_start("TIDPUNKT"),
            "event_time": months_between_periods(month_start("TIDPUNKT"), F.col("cohort")),
            outcome_col: _numeric(df, outcome_col),
        }
    )


def pair_panel(matches: DataFrame, month_result: DataFrame, outcome_col: str = OUTCOME,
               price_col: str = "price") -> DataFrame:
    """M2: treated outcome vs. mean of its matched controls in the same month.

    ``n_controls`` counts controls with a non-missing outcome.  When the
    monthly table carries a price column, the control mean is taken per price
    (controls of one price are never mixed with another).
    """
    m = with_cohort(matches)
    has_price = price_col in month_result.columns
    mr = month_result.select(
        "aID",
        month_start("TIDPUNKT").alias("TIDPUNKT"),
        *([F.col(price_col)] if has_price else []),
        _numeric(month_result, outcome_col).alias("_y"),
    )
    keys = ["treated_id", "cohort", "TIDPUNKT"] + ([price_col] if has_price else [])
    ctrl = (
        m.select("treated_id", "control_id", "cohort")
        .join(mr.withColumnRenamed("aID", "control_id"), "control_id")
        .groupBy(*keys)
        .agg(F.avg("_y").alias("matched_control_y"), F.count("_y").alias("n_controls"))
    )
    tr = (
        m.select("treated_id", "cohort").distinct()
        .join(mr.withColumnRenamed("aID", "treated_id"), "treated_id")
        .withColumnRenamed("_y", "treated_y")
    )
    df = tr.join(ctrl, keys, "inner")
    return df.select(
        "treated_id", "cohort", "TIDPUNKT", "treated_y", *([price_col] if has_price else []),
        "matched_control_y", "n_controls",
        months_between_periods("TIDPUNKT", "cohort").alias("event_time"),
        (F.col("treated_y") - F.col("matched_control_y")).alias("pair_effect"),
    )


def match_weights(matches: DataFrame) -> DataFrame:
    """M3a–b: treated weight 1; control weight Σ 1/(controls of the treated unit)
    over its edges in the cohort."""
    m = with_cohort(matches)
    per_treated = m.groupBy("treated_id", "cohort").agg(F.count("control_id").alias("_n"))
    cw = (
        m.join(per_treated, ["treated_id", "cohort"])
        .groupBy(F.col("control_id").alias("aID"), "cohort")
        .agg(F.sum(1.0 / F.col("_n")).alias("match_weight"))
        .withColumn("treatment", F.lit(0))
    )
    tw = (
        m.select(F.col("treated_id").alias("aID"), "cohort").distinct()
        .withColumn("treatment", F.lit(1)).withColumn("match_weight", F.lit(1.0))
    )
    return tw.select("aID", "cohort", "treatment", "match_weight").unionByName(
        cw.select("aID", "cohort", "treatment", "match_weight")
    )


def weighted_panel(matches: DataFrame, month_result: DataFrame, outcome_col: str | None = None) -> DataFrame:
    """M3: monthly rows × match weights with DiD columns.

    ``month_id`` / ``cohort_id`` are 'YYYY-MM'; ``entity_id`` = aID +
    '_cohort_' + cohort_id + '_tr_' + treatment; ``post`` = event_time >= 0;
    ``D`` = treatment × post.
    """
    df = month_result.join(match_weights(matches), "aID", "inner")
    month = month_start("TIDPUNKT")
    cols = {
        "TIDPUNKT": month,
        "month_id": month_label(month),
        "cohort_id": month_label("cohort"),
        "event_time": months_between_periods(month, F.col("cohort")),
    }
    df = df.withColumns(cols)
    df = df.withColumns(
        {
            "post": (F.col("event_time") >= 0).cast("int"),
            "entity_id": F.concat_ws("", F.col("aID"), F.lit("_cohort_"), F.col("cohort_id"), F.lit("_tr_"),
                                     F.col("treatment").cast("string")),
        }
    ).withColumn("D", F.col("treatment") * F.col("post"))
    if outcome_col is not None and outcome_col in df.columns:
        df = df.withColumn(outcome_col, _numeric(df, outcome_col))
    return df
