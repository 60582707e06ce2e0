"""Readers for meter readings, tariff contracts and small literal tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Public holidays that count as low-price days (2023–2026)
DEFAULT_HOLIDAYS = (
    "2023-01-01", "2023-01-06", "2023-04-07", "2023-04-10",
    "2023-12-24", "2023-12-25", "2023-12-26", "2023-12-31",
    "2024-01-01", "2024-01-06", "2024-03-29", "2024-04-01",
    "2024-12-24", "2024-12-25", "2024-12-26", "2024-12-31",
    "2025-01-01", "2025-01-06", "2025-04-18", "2025-04-21",
    "2025-12-24", "2025-12-25", "2025-12-26", "2025-12-31",
    "2026-01-01", "2026-01-06", "2026-04-03", "2026-04-06",
)

# Raw contract export: header line, ';' separated, every field a string.
TARIFF_CSV_SCHEMA = T.StructType(
    [
        T.StructField("GS1-nr.", T.StringType()),
        T.StructField("Startdatum", T.StringType()),
        T.StructField("Produktnamn", T.StringType()),
    ]
)


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """Meter readings from Parquet (schema from the files)."""
    return spark.read.parquet(path)


def read_tariff_csv(spark: SparkSession, path: str, schema: T.StructType = TARIFF_CSV_SCHEMA) -> DataFrame:
    """Contract CSV, header, ``;`` separated, explicit all-string schema."""
    return spark.read.csv(path, header=True, sep=";", schema=schema)


def register_tariff_view(tariff: DataFrame, name: str = "tariff_df") -> DataFrame:
    """S3: expose the contracts to SQL."""
    tariff.createOrReplaceTempView(name)
    return tariff


def read_stage_output(spark: SparkSession, path: str) -> DataFrame:
    """Read back a stage output (month_data, matches, ...)."""
    return spark.read.parquet(path)


def holidays_frame(spark: SparkSession, dates: Iterable[str] = DEFAULT_HOLIDAYS) -> DataFrame:
    """Literal holiday table ``date DATE``."""
    return spark.createDataFrame([(d,) for d in dates], "date string").select(
        F.to_date("date").alias("date")
    )


def empty_frame(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    """Empty frame with an explicit schema."""
    return spark.createDataFrame([], schema)


def input_profile(
    readings: DataFrame,
    tariff: DataFrame | None = None,
    id_col: str = "aID",
    ts_col: str = "TIDPUNKT",
    day_col: str | None = None,
) -> DataFrame:
    """Distinct households, distinct days, contract rows — one row.

    The reference counts distinct values of a stored day column; when the
    readings carry none the day is derived from the timestamp.
    """
    day = F.col(day_col) if day_col else F.to_date(F.col(ts_col))
    prof = readings.agg(
        F.count_distinct(F.col(id_col)).alias("n_households"),
        F.count_distinct(day).alias("n_days"),
        F.count(F.lit(1)).alias("n_readings"),
    )
    if tariff is None:
        return prof.withColumn("n_tariff_rows", F.lit(0).cast("long"))
    # both sides are single-row aggregates: the cross join is 1 x 1
    return prof.crossJoin(tariff.agg(F.count(F.lit(1)).alias("n_tariff_rows")))
