"""Normalisation and enrichment of meter readings."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kwhlens.functions.dates import to_ntz
from kwhlens.functions.stats import null_if_nan
from kwhlens.sources.readers import DEFAULT_HOLIDAYS

# Tariff calendar of the high-price period
HIGH_PRICE_MONTHS = (11, 12, 1, 2, 3)
HIGH_PRICE_WEEKDAYS = (2, 6)  # Spark dayofweek: 1 = Sunday, so Monday..Friday
HIGH_PRICE_HOURS = (7, 19)  # inclusive
# Plan label patterns (contract product names such as "Tid 16 kW Villa")
PLAN_PATTERN = r"(\d+\s*kW\s*(?:Villa|Normal))"
PLAN_GROUP_PATTERN = r"(\d+\s*kW\s*\w+)"

RAW_TARIFF_NAMES = {"GS1-nr.": "aID", "Startdatum": "tariff_start", "Produktnamn": "tariff_plan"}


def _dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def _to_double(df: DataFrame, name: str) -> Column:
    dt = _dtype(df, name)
    c = F.col(name)
    if isinstance(dt, T.StringType):
        c = c.try_cast("double")
    else:
        c = c.cast("double")
    return null_if_nan(c)


def normalize_readings(
    readings: DataFrame,
    id_col: str = "aID",
    ts_col: str = "TIDPUNKT",
    value_col: str = "FORBRUKNING_KWH",
) -> DataFrame:
    """``aID`` string, ``TIDPUNKT`` wall-clock timestamp, kWh double.

    Unparsable timestamps / numbers become NULL (no ANSI failure); rows without
    household id or timestamp are dropped at the source (they cannot belong
    to any period group).
    """
    out = readings.select(
        F.col(id_col).cast("string").alias("aID"),
        to_ntz(F.col(ts_col), _dtype(readings, ts_col)).alias("TIDPUNKT"),
        _to_double(readings, value_col).alias("FORBRUKNING_KWH"),
    )
    return out.where(F.col("aID").isNotNull() & F.col("TIDPUNKT").isNotNull())


def normalize_tariff(tariff: DataFrame) -> DataFrame:
    """Rename raw export columns, id as string, start as timestamp."""
    for raw, name in RAW_TARIFF_NAMES.items():
        if raw in tariff.columns:
            tariff = tariff.withColumnRenamed(raw, name)
    return tariff.select(
        F.col("aID").cast("string").alias("aID"),
        to_ntz(F.col("tariff_start"), _dtype(tariff, "tariff_start")).alias("tariff_start"),
        F.col("tariff_plan").cast("string").alias("tariff_plan"),
    )


def attach_tariff(readings: DataFrame, tariff: DataFrame | None) -> DataFrame:
    """Left join contracts on ``aID``; ``has_tariff`` and ``tariff_active``.

    Several contracts for one household fan the readings out (one row per
    contract), as in a plain left join.  No broadcast hint: the optimizer (and
    AQE at run time, on measured sizes) decides between broadcast hash join
    and sort-merge join, so a contract table of any size is safe.  Without
    contracts the columns exist with NULL / 0 values.
    """
    if tariff is None:
        out = readings.withColumns(
            {
                "tariff_start": F.lit(None).cast("timestamp_ntz"),
                "tariff_plan": F.lit(None).cast("string"),
            }
        )
    else:
        out = readings.join(normalize_tariff(tariff), "aID", "left")
    has = F.col("tariff_start").isNotNull()
    return out.withColumns(
        {
            "has_tariff": F.when(has, 1).otherwise(0),
            "tariff_active": F.when(has & (F.col("TIDPUNKT") >= F.col("tariff_start")), 1).otherwise(0),
        }
    )


def holiday_flag(ts: Column, holidays: Iterable[str] | DataFrame = DEFAULT_HOLIDAYS) -> Column:
    """P6 for a literal calendar: an ``InSet`` test, no join needed."""
    days = [F.lit(d).cast("date") for d in holidays]
    return F.coalesce(F.to_date(ts).isin(days), F.lit(False))


def add_price_period(df: DataFrame, holidays: Iterable[str] | DataFrame = DEFAULT_HOLIDAYS) -> DataFrame:
    """``price`` = high | low.

    high iff month in Nov..Mar, Monday..Friday, hour 7..19 and not a holiday.
    A holiday *DataFrame* (one row per day, bounded by the calendar) is joined
    with a broadcast hint; a list of dates is tested inline.
    """
    ts = F.col("TIDPUNKT")
    if isinstance(holidays, DataFrame):
        hol = F.broadcast(holidays.select(F.col("date").cast("date").alias("_hday")).distinct()
                          .withColumn("_is_holiday", F.lit(True)))
        df = df.join(hol, F.to_date(ts) == F.col("_hday"), "left").drop("_hday")
        is_hol = F.coalesce(F.col("_is_holiday"), F.lit(False))
    else:
        is_hol = holiday_flag(ts, holidays)
    high = (
        F.month(ts).isin(list(HIGH_PRICE_MONTHS))
        & F.dayofweek(ts).between(*HIGH_PRICE_WEEKDAYS)
        & F.hour(ts).between(*HIGH_PRICE_HOURS)
        & ~is_hol
    )
    out = df.withColumn("price", F.when(high, "high").otherwise("low"))
    return out.drop("_is_holiday") if "_is_holiday" in out.columns else out


def expand_price(df: DataFrame, use_price: bool = True,
                 holidays: Iterable[str] | DataFrame = DEFAULT_HOLIDAYS) -> DataFrame:
    """Off → every reading once with price 'all'; on → twice ('all' and high/low).

    One scan and an ``explode`` of a two-element array instead of a union of
    two scans.
    """
    if not use_price:
        return df.withColumn("price", F.lit("all"))
    df = add_price_period(df, holidays)
    return df.withColumn("price", F.explode(F.array(F.lit("all"), F.col("price"))))


def add_period(df: DataFrame, freq: str = "month") -> DataFrame:
    """``period`` = hour | week_part | weekday (1=Sunday) | date_trunc(freq)."""
    ts = F.col("TIDPUNKT")
    if freq == "hour":
        p = F.hour(ts)
    elif freq == "week_part":
        p = F.when(F.dayofweek(ts).between(2, 6), "weekday").otherwise("weekend")
    elif freq == "weekday":
        p = F.dayofweek(ts)
    else:
        p = F.date_trunc(freq, ts).cast("timestamp_ntz")
    return df.withColumn("period", p)


def price_slice(df: DataFrame, price, price_col: str = "price") -> DataFrame:
    """P10: one price value or a list of them."""
    if isinstance(price, (list, tuple, set)):
        return df.where(F.col(price_col).isin(list(price)))
    return df.where(F.col(price_col) == F.lit(price))


def prepare_price_panel(month_result: DataFrame, price_value: str,
                        outcome_col: str = "top3_mean_consumption") -> DataFrame:
    """One price slice, month as DATE, outcome coerced to double (bad → NULL)."""
    out = price_slice(month_result, price_value)
    return out.withColumns(
        {
            "TIDPUNKT": F.trunc(F.to_date("TIDPUNKT"), "month"),
            outcome_col: _to_double(out, outcome_col),
        }
    )


def plan_label(c, pattern: str = PLAN_PATTERN) -> Column:
    """Plan label such as '16 kW Villa'; no match → NULL."""
    c = F.col(c) if isinstance(c, str) else c
    v = F.regexp_extract(c, pattern, 1)
    return F.when(v != "", v)


def enrich_readings(readings: DataFrame, tariff: DataFrame | None = None,
                    holidays: Sequence[str] | DataFrame = DEFAULT_HOLIDAYS) -> DataFrame:
    """P1–P7 in one plan: normalised readings with contract flags and price."""
    return add_price_period(attach_tariff(normalize_readings(readings), tariff), holidays)


def enriched_counts(enriched: DataFrame) -> DataFrame:
    """Summary of P1–P7: readings, kWh, high-price and active readings per price."""
    return enriched.groupBy("price").agg(
        F.count(F.lit(1)).alias("n_readings"),
        F.sum("FORBRUKNING_KWH").alias("sum_kwh"),
        F.sum("tariff_active").cast("long").alias("n_active"),
        F.sum("has_tariff").cast("long").alias("n_with_tariff"),
        F.count_distinct("aID").alias("n_households"),
    )
