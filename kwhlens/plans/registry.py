"""Registered queries: Spark implementation + independent DuckDB SQL oracle.

Every query reads the supplied test tables through the FIXTURES mapping (so its
work grows with the data) and returns a DataFrame whose DOUBLE columns are
rounded to 6 digits; the oracle SQL rounds the same columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kwhlens.operators import aggregate as A
from kwhlens.operators import readings as P
from kwhlens.plans import oracle as O
from kwhlens.sources import fixtures as fx
from kwhlens.sources import readers as R

DIGITS = 6
NUDGE = 1e-9


@dataclass
class Query:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: str


REGISTRY: dict[str, Query] = {}

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Output boundary: DOUBLE rounded to ``digits``, DATE as midnight TIMESTAMP."""
    cols = []
    m = float(10 ** digits)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # nudge by 1e-9 away from zero, scale, round, unscale: the same
            # arithmetic as the oracle's round(x + sign(x)*1e-9, d).  Exact
            # decimal half-way values (k/2^n) no longer sit on the rounding
            # boundary, where 1-ulp differences between engines would flip them
            x = F.col(f.name) + F.signum(F.col(f.name)) * F.lit(NUDGE)
            cols.append((F.round(x * F.lit(m), 0) / F.lit(m)).alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            # the same value, one representation on both sides of the comparison
            cols.append(F.col(f.name).cast("timestamp_ntz").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def register(name: str, ops: str, sql: str | None = None):
    def deco(fn):
        def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))

        REGISTRY[name] = Query(wrapped, sql, ops)
        return fn

    return deco


def finalize_sql(sql: str, con) -> str:
    """Apply the output boundary to an oracle statement (types via DESCRIBE)."""
    desc = con.execute(f"DESCRIBE {sql}").fetchall()
    reps = []
    for row in desc:
        col, typ = row[0], str(row[1]).upper()
        if typ in ("DOUBLE", "FLOAT", "REAL") or typ.startswith("DECIMAL"):
            x = f'CAST("{col}" AS DOUBLE)'
            reps.append(f'round({x} + sign({x}) * {NUDGE!r}, {DIGITS}) AS "{col}"')
        elif typ == "DATE":
            reps.append(f'CAST("{col}" AS TIMESTAMP) AS "{col}"')
    if not reps:
        return sql
    return f"SELECT * REPLACE ({', '.join(reps)}) FROM (\n{sql}\n) q"


def oracle_statements(smoke_dir: str = "/root/testdata/sf0.001") -> dict[str, str]:
    import os

    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{smoke_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    out = {}
    for name, q in REGISTRY.items():
        if q.sql:
            try:
                out[name] = finalize_sql(q.sql, con)
            except Exception:  # noqa: BLE001 - keep the raw statement if it cannot be described
                out[name] = q.sql
    return out


# ---------------------------------------------------------------- shared inputs
def month_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel A monthly table: top3_mean + variance + mean, usage groups (exact cuts)."""
    return A.aggregate_readings(
        fx.panel_a_readings(spark, sf_dir),
        fx.panel_a_tariff(spark, sf_dir),
        freq="month",
        agg_method=["top3_mean", "variance", "mean"],
        use_price=True,
        add_user_group_col=[0.25, 0.75],
    )


# ---------------------------------------------------------------- S / P
register(
    "input_profile", "S13",
    O.with_ctes(O.READINGS_A + "," + O.TARIFF_A, """
SELECT (SELECT count(DISTINCT aID) FROM readings) AS n_households,
       (SELECT count(DISTINCT CAST(TIDPUNKT AS DATE)) FROM readings) AS n_days,
       (SELECT count(*) FROM readings) AS n_readings,
       (SELECT count(*) FROM tariff) AS n_tariff_rows"""),
)(lambda spark, d: R.input_profile(P.normalize_readings(fx.panel_a_readings(spark, d)), fx.panel_a_tariff(spark, d)))


register(
    "readings_enriched_counts", "P1-P7",
    O.with_ctes(O.READINGS_B + "," + O.TARIFF_B + "," + O.ENRICHED, """
SELECT price, count(*) AS n_readings, sum(FORBRUKNING_KWH) AS sum_kwh,
       CAST(sum(tariff_active) AS BIGINT) AS n_active, CAST(sum(has_tariff) AS BIGINT) AS n_with_tariff,
       count(DISTINCT aID) AS n_households
FROM enriched GROUP BY price"""),
)(lambda spark, d: P.enriched_counts(P.enrich_readings(fx.panel_b_readings(spark, d), fx.panel_b_tariff(spark, d))))


# ---------------------------------------------------------------- A
register(
    "agg_month_peaks", "P8,P9,A2,A3,A7,A8,A9-A16",
    O.with_ctes(O.month_result_ctes("A"), "SELECT * FROM month_result"),
)(month_result)


def _simple_agg_sql(panel: str, freq: str, use_price: bool, aggs: str) -> str:
    src = (O.READINGS_A + "," + O.TARIFF_A) if panel == "A" else (O.READINGS_B + "," + O.TARIFF_B)
    ctes = f"{src},{O.ENRICHED},{O.exploded(freq, use_price)},{O.TARIFF_INFO}"
    return O.with_ctes(ctes, f"""
SELECT s.*, ti.tariff_start, ti.tariff_plan FROM (
  SELECT aID, period AS TIDPUNKT, price, tariff_active, {aggs} FROM ex GROUP BY {O.KEYS}) s
LEFT JOIN tinfo ti ON s.aID = ti.aID""")


def _simple_agg(panel: str, freq: str, methods, use_price: bool = True, **kw):
    def fn(spark, d):
        r = fx.panel_a_readings(spark, d) if panel == "A" else fx.panel_b_readings(spark, d)
        t = fx.panel_a_tariff(spark, d) if panel == "A" else fx.panel_b_tariff(spark, d)
        return A.aggregate_readings(r, t, freq=freq, agg_method=methods, use_price=use_price, **kw)

    return fn


register("agg_hour_mean", "P9,A2", _simple_agg_sql("B", "hour", True, "avg(kwh) AS mean_consumption"))(_simple_agg("B", "hour", ["mean"]))
register("agg_weekday_mean", "P9,A2", _simple_agg_sql("B", "weekday", True, "avg(kwh) AS mean_consumption"))(_simple_agg("B", "weekday", ["mean"]))
register("agg_week_part_mean", "P9,A2", _simple_agg_sql("B", "week_part", True, "avg(kwh) AS mean_consumption"))(_simple_agg("B", "week_part", ["mean"]))
register(
    "agg_sum_max", "A1,A5,P8",
    _simple_agg_sql("B", "day", True, "sum(kwh) AS sum_consumption, max(kwh) AS max_consumption"),
)(_simple_agg("B", "day", ["sum", "max"]))
register(
    "agg_no_price", "A1,A3,P8(off)",
    _simple_agg_sql("A", "month", False, "sum(kwh) AS sum_consumption, var_samp(kwh) AS variance_consumption"),
)(_simple_agg("A", "month", ["sum", "variance"], use_price=False))
register(
    "agg_median_quantile", "A4,A6",
    _simple_agg_sql("B", "week_part", True,
                    "quantile_disc(kwh, 0.5) AS median_consumption, quantile_disc(kwh, 0.9) AS q90_consumption"),
)(_simple_agg("B", "week_part", ["median", "q90"]))


register(
    "usage_groups", "A9-A11",
    O.with_ctes(O.READINGS_A + "," + O.USAGE, "SELECT * FROM usage"),
)(lambda spark, d: A.usage_groups(A.household_totals(P.normalize_readings(fx.panel_a_readings(spark, d)))))

register(
    "tariff_info", "A13,P12",
    O.with_ctes(O.TARIFF_A + "," + O.TARIFF_INFO, "SELECT * FROM tinfo"),
)(lambda spark, d: A.tariff_info(fx.panel_a_tariff(spark, d)))
