"""Registered round trips of readers and sinks (S1–S6, S8–S12): written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kwhlens.operators import aggregate as A
from kwhlens.operators import effects as E
from kwhlens.operators import readings as P
from kwhlens.operators.panel import prepare_matching_data
from kwhlens.operators.profiles import calendar_feature_names
from kwhlens.plans import oracle as O
from kwhlens.plans import oracle_matching as OM
from kwhlens.plans import pipelines as L
from kwhlens.plans.q_effects import panel_m1, panel_m2
from kwhlens.plans.q_matching import l1, sfx, sql_risk
from kwhlens.plans.registry import REGISTRY, month_result, register
from kwhlens.session import Scratch
from kwhlens.sources import fixtures as fx
from kwhlens.sources import readers as R
from kwhlens.sources import sinks as K


def folder(spark: SparkSession) -> str:
    return Scratch(spark, "round-trip").path


def readings_parquet(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    K.save_parquet(fx.panel_b_readings(spark, d), path)
    return R.input_profile(P.normalize_readings(R.read_readings(spark, path)), fx.panel_b_tariff(spark, d))


def tariff_csv(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    fx.panel_a_raw_tariff(spark, d).write.option("header", True).option("sep", ";").csv(path)
    return A.tariff_info(R.register_tariff_view(R.read_tariff_csv(spark, path)))


def tariff_view(spark: SparkSession, d: str) -> DataFrame:
    name = f"tariff_{uuid.uuid4().hex}"
    R.register_tariff_view(P.normalize_tariff(fx.panel_a_tariff(spark, d)), name)
    return spark.sql(f"SELECT tariff_plan, count(*) AS n FROM {name} GROUP BY tariff_plan")


def holidays_joined(spark: SparkSession, d: str) -> DataFrame:
    days = R.holidays_frame(spark)
    return P.enriched_counts(P.enrich_readings(fx.panel_b_readings(spark, d), fx.panel_b_tariff(spark, d), days))


def empty_united(spark: SparkSession, d: str) -> DataFrame:
    totals = A.household_totals(P.normalize_readings(fx.panel_b_readings(spark, d)))
    return totals.unionByName(R.empty_frame(spark, totals.schema))


def table_sink(spark: SparkSession, d: str) -> DataFrame:
    name = f"day_table_{uuid.uuid4().hex}"
    path = folder(spark)
    A.run(fx.panel_b_readings(spark, d), fx.panel_b_tariff(spark, d), freq="day", agg_method=["sum", "max"],
          table_name=name, table_path=path)
    out = R.read_stage_output(spark, path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return out


def partitioned_parquet(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    result = A.aggregate_readings(fx.panel_b_readings(spark, d), fx.panel_b_tariff(spark, d), freq="weekday",
                                  agg_method=["mean"])
    K.save_parquet(result, path, partition_by=["price"])
    return R.read_stage_output(spark, path)


def matching_bundle(spark: SparkSession, d: str, part: str) -> DataFrame:
    path = folder(spark)
    L.save_run(l1(spark, d), path, {"k_neighbors": 5})
    if part == "config":
        row = spark.read.text(f"{path}/config")
        return row.select(F.get_json_object("value", "$.k_neighbors").cast("int").alias("k_neighbors"))
    return R.read_stage_output(spark, f"{path}/{part}")


def risk_set_from_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The risk set from the monthly table stored in buckets by household (the catalog entry goes, the files stay)."""
    name = f"month_{uuid.uuid4().hex}"
    month = K.save_bucketed(month_result(spark, d), name, path=folder(spark))
    out = prepare_matching_data(month, lookback_months=12)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return out


def named_run(spark: SparkSession, d: str, name: str) -> DataFrame:
    return L.run_named(month_result(spark, d), name)["matches"]


def bundle_member(spark: SparkSession, d: str, name: str, pairs: bool) -> DataFrame:
    path = folder(spark)
    panel = panel_m2(spark, d) if pairs else panel_m1(spark, d, "high")
    bundle = E.named_results(E.run_full_analysis(panel, pairs=pairs), pairs)
    K.save_tables({name: bundle[name]}, path)
    return spark.read.csv(f"{path}/{name}", header=True, schema=bundle[name].schema)


_B = O.with_ctes(O.READINGS_B + "," + O.TARIFF_B, """
SELECT (SELECT count(DISTINCT aID) FROM readings) AS n_households,
       (SELECT count(DISTINCT CAST(TIDPUNKT AS DATE)) FROM readings) AS n_days,
       (SELECT count(*) FROM readings) AS n_readings, (SELECT count(*) FROM tariff) AS n_tariff_rows""")
register("source_readings_parquet", "S1,S9", _B)(readings_parquet)
register("source_tariff_csv", "S2,S3", REGISTRY["tariff_info"].sql)(tariff_csv)
register("source_tariff_view", "S3", O.with_ctes(
    O.TARIFF_A, "SELECT tariff_plan, count(*) AS n FROM tariff GROUP BY tariff_plan"))(tariff_view)
register("source_holiday_frame", "S5,P6", REGISTRY["readings_enriched_counts"].sql)(holidays_joined)
register("source_empty_frame", "S6", O.with_ctes(
    O.READINGS_B, "SELECT aID, sum(FORBRUKNING_KWH) AS total_consumption FROM readings GROUP BY aID"))(empty_united)
register("sink_table", "S8,S4", REGISTRY["agg_sum_max"].sql)(table_sink)
register("sink_partitioned_parquet", "S9,S10,S4", REGISTRY["agg_weekday_mean"].sql)(partitioned_parquet)
register("sink_matching_matches", "L1,L4,S4", REGISTRY["knn_blocked"].sql)(
    lambda s, d: matching_bundle(s, d, "matches"))
register("sink_matching_balance", "L1,L4,S4", REGISTRY["balance_pooled"].sql)(
    lambda s, d: matching_bundle(s, d, "balance"))
register("sink_matching_config", "L4,S12", "SELECT 5 AS k_neighbors FROM (SELECT count(*) FROM lineitem) r")(
    lambda s, d: matching_bundle(s, d, "config"))
register("risk_set_bucketed", "S9,R5,R8", REGISTRY["risk_set_never"].sql)(risk_set_from_buckets)
# the nine group-mean and seven pair-level result tables, each written under its name and read back
_SQL_OF = {
    False: {"overall": "effect_group", "cohort": "effect_group_cohort", "pretrend": "pretrend", "att_all": "att_all",
            "att_3m": "att_3m", "att_by_cohort_all": "att_cohort", "att_by_cohort_3m": "att_cohort_3m"},
    True: {"overall": "effect_pair", "cohort": "effect_pair_cohort", "pretrend": "pretrend_pairs", "att_all": "att_pairs",
           "att_3m": "att_pairs_3m", "att_by_cohort_all": "att_pairs_cohort", "att_by_cohort_3m": "att_pairs_cohort_3m"},
}
for _pairs, _names in ((False, E.GROUP_RESULT_NAMES), (True, E.PAIR_RESULT_NAMES)):
    for _name, _key in _names.items():
        register(f"saved_{'pair_' if _pairs else ''}{_name}", "S11,E9", REGISTRY[_SQL_OF[_pairs][_key]].sql)(
            lambda s, d, name=_name, pairs=_pairs: bundle_member(s, d, name, pairs))
register("named_run_summary_4", "L1", REGISTRY["knn_summary4"].sql)(lambda s, d: named_run(s, d, "all/summary_4"))
register("named_run_time_series", "L2", REGISTRY["knn_lags"].sql)(lambda s, d: named_run(s, d, "all/time_series"))
register("named_run_calendar_1year", "L3", REGISTRY["knn_missing_1year"].sql)(
    lambda s, d: named_run(s, d, "all/calendar_1year"))


def _run_sql(name: str) -> str:
    """The matches of a named run: its risk set, profile, standardisation and matching in SQL."""
    risk_kw, kind, kw = L.RUN_CONFIGS[name]
    prices = tuple(risk_kw.get("price_values") or [risk_kw.get("price_value", "all")])
    chain = sql_risk(risk_kw["lookback_months"], prices, match_months=risk_kw.get("match_months"))
    k = kw.get("k_neighbors", 5)
    if kind == "summary":
        features = kw["summary_vars"]
        chain += "," + OM.summary_profile(OM.value_cols(list(prices)), sfx(prices), features)
        match = OM.knn_blocked(features, k, 0.3, next(f for f in features if f.startswith("peak_mean")))
    elif kind == "time_series":
        features = [f"peak_lag_{i}" for i in range(1, kw["lookback_months"] + 1)]
        chain += "," + OM.lag_profile(kw["lookback_months"], OM.value_cols(list(prices)))
        match = OM.knn_missing(features, k)
    else:
        features = calendar_feature_names(list(L.CALENDAR_MONTHS), kw["lookback_years"], sfx(prices))
        chain += "," + OM.calendar_profile(list(L.CALENDAR_MONTHS), kw["lookback_years"], sfx(prices))
        match = OM.knn_missing(features, k)
    dim = "CAST(NULL AS INTEGER) AS valid_dim" if kind == "summary" else "CAST(valid_dim AS INTEGER) AS valid_dim"
    return O.with_ctes(chain + "," + OM.standardize(features) + "," + match, f"""
SELECT '{name}' AS run, treated_id, control_id, adoption_month, distance, {dim}, match_rank FROM matches""")


register("named_runs_all", "L1,L2,L3,R11", "SELECT * FROM (" + ")\nUNION ALL SELECT * FROM (".join(
    _run_sql(name) for name in L.RUN_CONFIGS) + ")")(
    lambda s, d: L.tagged_matches(L.run_batch(month_result(s, d))))
