"""A1–A16 and P1–P12 on hand-made frames (hazards H2, H4, H6, H7, H11, H16)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kwhlens.operators import aggregate as A
from kwhlens.operators import readings as P

SCHEMA = "aID string, TIDPUNKT string, FORBRUKNING_KWH string"


def readings(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def tariff(spark, data):
    return spark.createDataFrame(data, "`GS1-nr.` string, Startdatum string, Produktnamn string")


def test_unparsable_values_and_null_keys_dropped(spark):
    df = readings(spark, [
        ("1", "2024-01-01 08:00:00", "1.5"),
        ("1", "not a time", "2.0"),
        (None, "2024-01-01 09:00:00", "3.0"),
        ("1", "2024-01-01 10:00:00", "n/a"),
    ])
    out = P.normalize_readings(df).orderBy("TIDPUNKT").collect()
    assert len(out) == 2
    assert out[0].FORBRUKNING_KWH == 1.5 and out[1].FORBRUKNING_KWH is None


def test_price_period_rules(spark):
    df = readings(spark, [
        ("1", "2024-01-02 07:00:00", "1"),   # Tue, winter, 7h -> high
        ("1", "2024-01-02 19:59:00", "1"),   # 19h inclusive -> high
        ("1", "2024-01-02 20:00:00", "1"),   # 20h -> low
        ("1", "2024-01-06 10:00:00", "1"),   # holiday (and Saturday) -> low
        ("1", "2024-01-01 10:00:00", "1"),   # Monday holiday -> low
        ("1", "2024-04-02 10:00:00", "1"),   # April -> low
        ("1", "2024-01-07 10:00:00", "1"),   # Sunday -> low
    ])
    out = P.enrich_readings(df).orderBy("TIDPUNKT").select("price").collect()
    assert [r.price for r in out] == ["low", "high", "high", "low", "low", "low", "low"]


def test_month_top3_ties_and_short_months(spark):
    df = readings(spark, [
        # January: 4 days; day 3 has a tie at 9.0 -> earliest time wins (H7)
        ("1", "2024-01-03 05:00:00", "9.0"), ("1", "2024-01-03 04:00:00", "9.0"),
        ("1", "2024-01-04 05:00:00", "7.0"), ("1", "2024-01-05 05:00:00", "8.0"),
        ("1", "2024-01-06 05:00:00", "1.0"), ("1", "2024-01-06 06:00:00", "2.0"),
        # February: 2 days -> no top-3 mean
        ("1", "2024-02-01 05:00:00", "3.0"), ("1", "2024-02-02 05:00:00", "4.0"),
    ])
    res = A.aggregate_readings(df, None, agg_method=["top3_mean", "variance", "mean", "sum", "max"],
                               use_price=False)
    r = {x.TIDPUNKT.month: x for x in res.collect()}
    jan = r[1]
    assert jan.peak1_consumption == 9.0 and jan.peak1_time == dt.datetime(2024, 1, 3, 4, 0)
    assert jan.peak2_consumption == 8.0 and jan.peak3_consumption == 7.0
    assert jan.top3_mean_consumption == pytest.approx(8.0)
    vals = [9, 9, 7, 8, 1, 2]
    m = sum(vals) / len(vals)
    assert jan.mean_consumption == pytest.approx(m)
    assert jan.variance_consumption == pytest.approx(sum((v - m) ** 2 for v in vals) / (len(vals) - 1))
    assert jan.sum_consumption == 36 and jan.max_consumption == 9
    assert r[2].top3_mean_consumption is None and r[2].peak3_time is None
    # H4: no contracts -> NULL contract columns, tariff_active 0
    assert jan.tariff_start is None and jan.tariff_active == 0


def test_mid_month_adoption_and_plan_label(spark):
    df = readings(spark, [
        ("7", "2024-01-10 08:00:00", "1.0"), ("7", "2024-01-20 08:00:00", "2.0"),
    ])
    t = tariff(spark, [("7", "2024-01-15", "Tid 16 kW Villa")])
    res = A.aggregate_readings(df, t, agg_method="mean", use_price=False).orderBy("tariff_active").collect()
    assert [r.tariff_active for r in res] == [0, 1]   # H6: two monthly rows
    assert res[0].tariff_plan == "16 kW Villa"       # H2: the pattern matches
    assert res[0].tariff_start == dt.datetime(2024, 1, 15)


def test_several_contracts_fan_out(spark):
    df = readings(spark, [("7", "2024-01-10 08:00:00", "1.0")])
    t = tariff(spark, [("7", "2024-01-01", "Tid 16 kW Villa"), ("7", "2024-02-01", "Tid 25 kW Normal")])
    enriched = P.attach_tariff(P.normalize_readings(df), t)
    assert enriched.count() == 2
    info = A.tariff_info(t).collect()[0]
    assert info.tariff_start == dt.datetime(2024, 1, 1) and info.tariff_plan == "16 kW Villa"


def test_all_equals_high_plus_low(spark):
    data = [("1", f"2024-01-{d:02d} {h:02d}:00:00", str(d + h / 10)) for d in range(2, 12) for h in range(0, 24, 5)]
    res = A.aggregate_readings(readings(spark, data), None, agg_method="sum", use_price=True)
    s = {r.price: r.sum_consumption for r in res.groupBy("price").agg(F.sum("sum_consumption").alias("sum_consumption")).collect()}
    assert s["all"] == pytest.approx(s["high"] + s["low"])


def test_usage_groups_and_unknown_method(spark):
    data = [(str(i), "2024-01-02 08:00:00", str(float(i))) for i in range(1, 9)]
    res = A.aggregate_readings(readings(spark, data), None, agg_method="mean", use_price=False,
                               add_user_group_col=[0.25, 0.75], usage_quantile_mode="exact")
    g = {r.aID: r.usage_group for r in res.collect()}
    assert g["1"] == "low" and g["2"] == "low" and g["3"] == "medium" and g["6"] == "medium" and g["8"] == "high"
    with pytest.raises(ValueError):
        A.aggregate_readings(readings(spark, data), None, agg_method="nope")


def test_hour_weekday_periods(spark):
    df = readings(spark, [("1", "2024-01-07 13:00:00", "1.0"), ("1", "2024-01-08 13:30:00", "3.0")])
    h = A.aggregate_readings(df, None, freq="hour", agg_method="mean", use_price=False).collect()
    assert [(r.TIDPUNKT, r.mean_consumption) for r in h] == [(13, 2.0)]
    w = A.aggregate_readings(df, None, freq="weekday", agg_method="mean", use_price=False).orderBy("TIDPUNKT").collect()
    assert [r.TIDPUNKT for r in w] == [1, 2]  # Sunday = 1, Monday = 2
    wp = A.aggregate_readings(df, None, freq="week_part", agg_method="mean", use_price=False).orderBy("TIDPUNKT").collect()
    assert [r.TIDPUNKT for r in wp] == ["weekday", "weekend"]


def test_median_quantile_exact(spark):
    data = [("1", f"2024-01-02 {h:02d}:00:00", str(float(h))) for h in range(1, 11)]
    res = A.aggregate_readings(readings(spark, data), None, agg_method=["median", "q90"], use_price=False).first()
    assert res.median_consumption == 5.0 and res.q90_consumption == 9.0


def test_input_order_never_changes_output(spark):
    """Shuffled readings give identical statistics and peak times (ties broken by time)."""
    from kwhlens.sources import fixtures as fx
    from tests.conftest import SMOKE

    r = fx.panel_a_readings(spark, SMOKE)
    t = fx.panel_a_tariff(spark, SMOKE)
    methods = ["top3_mean", "variance", "mean", "sum", "max"]
    a = A.aggregate_readings(r, t, agg_method=methods)
    b = A.aggregate_readings(r.repartition(7).orderBy(F.rand(11)), t, agg_method=methods)

    def key(row):
        return tuple((x is None, str(x)) for x in row)

    ra = sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in a.collect()), key=key)
    rb = sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in b.collect()), key=key)
    assert ra == rb


def _plain(rows, contracts, use_price):
    """The statistics by joining every reading with every contract of its household."""
    import collections
    import statistics

    groups = collections.defaultdict(list)
    for a, ts, k in rows:
        own = [s for h, s, _ in contracts if h == a] or [None]
        high = (ts.month in (11, 12, 1, 2, 3) and ts.weekday() < 5 and 7 <= ts.hour <= 19
                and ts.date() not in (dt.date(2024, 1, 1), dt.date(2024, 1, 6)))
        for s in own:
            active = int(s is not None and ts >= s)
            for p in ("all", "high" if high else "low") if use_price else ("all",):
                groups[a, ts.month, p, active].append((ts, k))
    out = {}
    for key, found in groups.items():
        v = sorted(k for _, k in found if k is not None)
        days = collections.defaultdict(list)
        for ts, k in found:
            days[ts.date()].append((k is None, -(k or 0), ts, k))
        top = sorted(min(d) for d in days.values())[:3]
        rank = lambda q: v[max(1, -(-int(q * 10) * len(v) // 10)) - 1] if v else None
        out[key] = (
            sum(v) if v else None, statistics.variance(v) if len(v) > 1 else None, max(v, default=None), rank(0.5), rank(0.9),
            tuple(t[2] for t in top) + (None,) * (3 - len(top)), tuple(t[3] for t in top) + (None,) * (3 - len(top)))
    return out


@pytest.mark.parametrize("kind", ["string", "date"])
@pytest.mark.parametrize("use_price", [True, False])
def test_contracts_after_midnight_and_several_per_household(spark, kind, use_price):
    """The eager form equals the join of every reading with every contract, also on days on which a contract starts."""
    import random

    r = random.Random(3)
    rows = [(str(a), dt.datetime(2024, m, d, h, r.choice([0, 30])), r.choice([None, 0.0, -1.5, 2.25, round(r.random() * 9, 3)]))
            for a in range(4) for m in (1, 2) for d in range(1, 9) for h in r.sample(range(24), 4)]
    rows += rows[:7]  # repeated readings
    contracts = [("0", dt.datetime(2024, 1, 3, 9), "x"), ("1", dt.datetime(2024, 1, 4), "x"), ("1", dt.datetime(2024, 2, 5, 13, 30), "y"),
                 ("1", dt.datetime(2024, 2, 5, 13, 30), "y"), ("2", None, "x"), ("2", dt.datetime(2024, 2, 2, 6), "x")]
    if kind == "date":
        contracts = [(a, s and dt.datetime(s.year, s.month, s.day), p) for a, s, p in contracts]
    t = spark.createDataFrame(
        [(a, s and (str(s) if kind == "string" else s.date()), p) for a, s, p in contracts],
        f"aID string, tariff_start {kind}, tariff_plan string")
    df = spark.createDataFrame(rows, "aID string, TIDPUNKT timestamp_ntz, FORBRUKNING_KWH double")
    res = A.aggregate_readings(df, t, agg_method=["sum", "variance", "max", "median", "q90", "top3_mean"], use_price=use_price,
                               add_user_group_col=[0.25, 0.75])
    got = {(x.aID, x.TIDPUNKT.month, x.price, x.tariff_active): (
        x.sum_consumption, x.variance_consumption, x.max_consumption, x.median_consumption, x.q90_consumption,
        (x.peak1_time, x.peak2_time, x.peak3_time), (x.peak1_consumption, x.peak2_consumption, x.peak3_consumption))
        for x in res.collect()}
    want = _plain(rows, contracts, use_price)
    assert got.keys() == want.keys()
    for key, w in want.items():
        assert got[key][:2] == (pytest.approx(w[0]), pytest.approx(w[1])), key
        assert got[key][2:] == w[2:], key
    totals = {x.aID: x.total_consumption for x in res.collect()}
    for a in totals:  # each reading counts once
        assert totals[a] == pytest.approx(sum(k for h, _, k in rows if h == a and k is not None))


def test_one_scan_and_no_join_of_readings(spark):
    """In the plan the readings are read once, and the contracts are joined above the household groups."""
    df = readings(spark, [("1", "2024-01-10 08:00:00", "1.0")])
    t = spark.createDataFrame([("1", dt.date(2024, 1, 5), "Tid 16 kW Villa")], "aID string, tariff_start date, tariff_plan string")
    res = A.aggregate_readings(df.withColumn("marker", F.lit("x")), t, agg_method=["top3_mean", "median", "mean"])
    plan = res._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2  # starts of the contracts, and the contract shown
    below, right = plan[plan.index("collect_list(struct(_day"):].split("Project [", 1)[0], plan
    assert "Join" not in below and right.count("marker") == 0
