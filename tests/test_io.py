"""S1–S13 readers / sinks and the L4 bundle: write, read back, compare."""

import json

from pyspark.sql import functions as F

from kwhlens.operators import aggregate as A
from kwhlens.operators.readings import normalize_tariff
from kwhlens.plans import pipelines as L
from kwhlens.sources import fixtures as fx
from kwhlens.sources import readers as R
from kwhlens.sources import sinks as K
from tests.conftest import SMOKE


def test_tariff_csv_roundtrip(spark, tmp_path):
    raw = fx.panel_a_raw_tariff(spark, SMOKE)
    path = str(tmp_path / "tariff_csv")
    raw.write.option("header", True).option("sep", ";").csv(path)
    back = R.read_tariff_csv(spark, path)
    assert [f.dataType.simpleString() for f in back.schema.fields] == ["string"] * 3
    assert back.columns == ["GS1-nr.", "Startdatum", "Produktnamn"]
    got = normalize_tariff(back).select("aID", F.to_date("tariff_start").alias("d"), "tariff_plan")
    want = fx.panel_a_tariff(spark, SMOKE).select("aID", F.to_date("tariff_start").alias("d"), "tariff_plan")
    assert sorted(got.collect()) == sorted(want.collect())
    R.register_tariff_view(back)
    assert spark.sql("SELECT count(*) FROM tariff_df").first()[0] == raw.count()


def test_holidays_and_empty_frame(spark):
    h = R.holidays_frame(spark)
    assert h.count() == 28 and h.schema["date"].dataType.simpleString() == "date"
    e = R.empty_frame(spark, "id string, Ti date, value double")
    assert e.count() == 0 and e.columns == ["id", "Ti", "value"]


def test_month_table_parquet_partitioned_roundtrip(spark, tmp_path):
    mr = A.aggregate_readings(fx.panel_a_readings(spark, SMOKE), fx.panel_a_tariff(spark, SMOKE),
                              agg_method=["top3_mean", "mean"])
    path = str(tmp_path / "month_data")
    K.save_parquet(mr, path, partition_by=["price"])
    back = R.read_stage_output(spark, path)
    assert back.count() == mr.count()
    # partition pruning on the price column
    assert back.where("price = 'high'").count() == mr.where("price = 'high'").count()


def test_save_run_bundle(spark, tmp_path):
    mr = A.aggregate_readings(fx.panel_a_readings(spark, SMOKE), fx.panel_a_tariff(spark, SMOKE),
                              agg_method=["top3_mean", "variance", "mean"], add_user_group_col=[0.25, 0.75])
    res = L.run_named(mr, "all/summary_4")
    folder = str(tmp_path / "bundle")
    L.save_run(res, folder, {"name": "all/summary_4", "k": 5})
    m = spark.read.parquet(f"{folder}/matches")
    assert m.count() == res["matches"].count()
    assert spark.read.parquet(f"{folder}/balance").count() == len(L.SUMMARY_4)
    cfg = json.loads(spark.read.text(f"{folder}/config").first()[0])
    assert cfg == {"k": 5, "name": "all/summary_4"}
    K.save_tables({"balance": res["balance"]}, str(tmp_path / "tables"))
    back = spark.read.option("header", True).csv(str(tmp_path / "tables" / "balance"))
    assert back.columns == ["covariate", "treated_mean", "control_mean", "SMD"]


def test_bucketed_table_needs_no_exchange_by_household(spark, tmp_path):
    import datetime as dt

    from kwhlens.operators.panel import VALUE_COLS, prepare_matching_data
    from kwhlens.sources.sinks import save_bucketed

    rows = [(str(i), dt.datetime(2022 + m // 12, m % 12 + 1, 1), "all", 0, dt.datetime(2023, 3, 1) if i % 3 == 0 else None,
             float(i), float(m), 1.0, 2.0) for i in range(12) for m in range(24)]
    df = spark.createDataFrame(rows, "aID string, TIDPUNKT timestamp_ntz, price string, tariff_active int, tariff_start timestamp_ntz, "
                               + ", ".join(f"{c} double" for c in VALUE_COLS))
    stored = save_bucketed(df, "month_buckets", path=f"{tmp_path}/month", buckets=4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        risk = prepare_matching_data(stored, lookback_months=6)
        plan = risk._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(aID" not in plan and "hashpartitioning(id" not in plan and "Bucketed: true" in plan
        from_rows = prepare_matching_data(df, lookback_months=6)
        assert "hashpartitioning(id" in from_rows._jdf.queryExecution().executedPlan().toString()
        assert risk.exceptAll(from_rows).count() == 0 and risk.count() == from_rows.count() > 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sql("DROP TABLE IF EXISTS month_buckets")
    assert len(list((tmp_path / "month").glob("part-*.parquet"))) == 4
