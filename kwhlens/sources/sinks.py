"""Sinks for stage outputs."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def save_table(df: DataFrame, table_name: str, fmt: str = "parquet", mode: str = "overwrite",
               partition_by: list[str] | None = None, path: str | None = None) -> None:
    """Table sink (``delta`` when the format is installed); with ``path`` the table is external."""
    w = df.write.format(fmt).mode(mode)
    if path is not None:
        w = w.option("path", path)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(table_name)


def save_bucketed(df: DataFrame, table_name: str, by: str = "aID", sort_by: tuple[str, ...] = ("aID", "TIDPUNKT"),
                  buckets: int | None = None, path: str | None = None, mode: str = "overwrite") -> DataFrame:
    """A stage table dealt into ``buckets`` files by ``by`` and sorted in each; returns the table.

    What groups, windows or joins by ``by`` (or an alias of it) then needs no exchange: the monthly table by
    household serves panels, status windows and matched panels.  The rows are dealt by the bucket hash first, so
    each bucket is one file.  ``buckets`` defaults to the shuffle partitions.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    w = df.repartition(n, by).write.format("parquet").mode(mode).bucketBy(n, by).sortBy(*sort_by)
    if path is not None:
        w = w.option("path", path)
    w.saveAsTable(table_name)
    return spark.table(table_name)


def save_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                 partition_by: list[str] | None = None) -> None:
    """Parquet sink; month/hour/weekday tables are best split by ``price``."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def save_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header, one directory per table."""
    df.write.mode(mode).option("header", True).csv(path)


def save_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "csv") -> None:
    """Write a bundle of result tables (effects, ATT, ...) under one folder."""
    for name, df in tables.items():
        if fmt == "csv":
            save_csv(df, f"{folder}/{name}")
        else:
            save_parquet(df, f"{folder}/{name}")


def save_config(spark: SparkSession, config: Mapping, path: str) -> None:
    """Run configuration as a one-row JSON dataset (works on any file system)."""
    text = json.dumps(config, ensure_ascii=False, default=str, sort_keys=True)
    spark.createDataFrame([(text,)], "config string").coalesce(1).write.mode("overwrite").text(path)


def save_matching_outputs(matches: DataFrame, profiles: DataFrame, balance: DataFrame,
                          config: Mapping, folder: str) -> None:
    """L4: matches, matched profiles, balance and the run configuration."""
    save_parquet(matches, f"{folder}/matches")
    save_parquet(profiles, f"{folder}/profiles")
    save_parquet(balance, f"{folder}/balance")
    save_config(matches.sparkSession, config, f"{folder}/config")
