"""Deterministic mapping of the supplied test tables to meter data (FIXTURES.md).

Panel A (83 months, monthly statistics / matching / DiD): ``lineitem`` →
readings, ``supplier`` → contracts.  Panel B (30 days, hour / weekday /
price-period logic): ``events`` → readings and contracts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel_a_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("aID"),
        F.expr(
            "l_shipdate + INTERVAL '24' YEAR"
            " + make_dt_interval(0, CAST((l_orderkey*7 + l_linenumber*5) % 24 AS INT))"
        ).alias("TIDPUNKT"),
        F.col("l_quantity").alias("FORBRUKNING_KWH"),
    )


def panel_a_tariff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _table(spark, sf_dir, "supplier")
        .where("s_suppkey % 3 = 0")
        .select(
            F.col("s_suppkey").cast("string").alias("aID"),
            F.expr(
                "date_add(add_months(DATE'2023-03-01', CAST(3*((s_suppkey DIV 3) % 4) AS INT)),"
                " CASE WHEN (s_suppkey DIV 3) % 2 = 1 THEN 14 ELSE 0 END)"
            ).alias("tariff_start"),
            F.expr(
                "CASE WHEN s_suppkey % 2 = 0 THEN 'Tid 16 kW Villa' ELSE 'Tid 25 kW Normal' END"
            ).alias("tariff_plan"),
        )
    )


def panel_b_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("aID"),
        F.col("ts").alias("TIDPUNKT"),
        F.col("value").alias("FORBRUKNING_KWH"),
    )


def panel_b_tariff(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _table(spark, sf_dir, "events").select("user_id").where("user_id % 3 = 0").distinct()
    return users.select(
        F.col("user_id").cast("string").alias("aID"),
        F.expr("date_add(DATE'2024-01-08', CAST(7*((user_id DIV 3) % 2) AS INT))").alias("tariff_start"),
        F.expr(
            "CASE WHEN user_id % 2 = 0 THEN 'Tid 16 kW Villa' ELSE 'Tid 25 kW Normal' END"
        ).alias("tariff_plan"),
    )


def panel_a_raw_tariff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel A contracts in the raw export layout (string columns, original names)."""
    t = panel_a_tariff(spark, sf_dir)
    return t.select(
        F.col("aID").alias("GS1-nr."),
        F.date_format("tariff_start", "yyyy-MM-dd").alias("Startdatum"),
        F.col("tariff_plan").alias("Produktnamn"),
    )
