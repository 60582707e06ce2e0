"""Benchmark the headline queries; prints one JSON line.

Stage layout follows the pipeline: the monthly table (A16) is written once to
a scratch folder and the later stages read it back, as the analyses do.
Each query is executed with a ``noop`` sink (full plan, nothing collected):
one warm-up, then the median of ``BENCH_REPEATS`` (default 3) timed runs.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_REPEATS (default 3), BENCH_QUERIES (comma list, default all)
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kwhlens import get_session  # noqa: E402
from kwhlens.session import checkpoint_dir  # noqa: E402
from kwhlens.operators import aggregate as A  # noqa: E402
from kwhlens.operators import effects as E  # noqa: E402
from kwhlens.operators import fixed_effects as D  # noqa: E402
from kwhlens.operators import matched as M  # noqa: E402
from kwhlens.operators.panel import prepare_matching_data  # noqa: E402
from kwhlens.operators.readings import prepare_price_panel  # noqa: E402
from kwhlens.plans import pipelines as L  # noqa: E402
from kwhlens.sources import fixtures as fx  # noqa: E402


def run_noop(*dfs):
    for df in dfs:
        df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    # stage outputs go to the shared folder the session names for checkpoints
    scratch = f"{checkpoint_dir(spark).rstrip('/')}/bench-{uuid.uuid4().hex}"
    month_path = f"{scratch}/month_data"

    def month_result():
        return A.aggregate_readings(
            fx.panel_a_readings(spark, sf_dir), fx.panel_a_tariff(spark, sf_dir), freq="month",
            agg_method=["top3_mean", "variance", "mean"], use_price=True, add_user_group_col=[0.25, 0.75],
        )

    # stage-1 output used by the later stages (written once, outside the timings)
    month_result().write.mode("overwrite").parquet(month_path)

    def mr():
        return spark.read.parquet(month_path)

    def q_a16():
        run_noop(month_result())

    def q_l1():
        risk = prepare_matching_data(mr().where("price = 'all'"), lookback_months=12)
        res = L.run_summary_matching(risk, summary_vars=L.SUMMARY_4)
        run_noop(res["matches"], res["balance"], res["balance_by_ti"])

    def q_l3():
        risk = prepare_matching_data(mr(), lookback_months=24, price_value="high")
        res = L.run_calendar_matching(risk, lookback_years=2, k_neighbors=5)
        run_noop(res["matches"], res["balance"], res["balance_by_ti"])

    # matches for stages 3-4 (written once, outside the timings)
    risk = prepare_matching_data(mr().where("price = 'all'"), lookback_months=12)
    L.run_summary_matching(risk, summary_vars=L.SUMMARY_4)["matches"].write.mode("overwrite").parquet(
        f"{scratch}/matches_s4")
    risk_h = prepare_matching_data(mr(), lookback_months=24, price_value="high")
    L.run_calendar_matching(risk_h, lookback_years=2, k_neighbors=5)["matches"].write.mode("overwrite").parquet(
        f"{scratch}/matches_cal")

    def q_e9():
        panel = M.unweighted_panel(spark.read.parquet(f"{scratch}/matches_s4"), mr()).where("price = 'high'")
        res = E.run_full_analysis(panel)
        run_noop(*res.values())

    def weighted():
        return M.weighted_panel(spark.read.parquet(f"{scratch}/matches_cal"),
                                prepare_price_panel(mr(), "high", "top3_mean_consumption"), "top3_mean_consumption")

    def q_d3():
        run_noop(D.fit_basic_did(weighted(), "top3_mean_consumption"))

    def q_d6():
        run_noop(D.fit_event_study(weighted(), "top3_mean_consumption", (-12, 12), -1))

    queries = {"a16_month": q_a16, "l1_summary": q_l1, "l3_calendar": q_l3, "e9_effects": q_e9,
               "d3_did": q_d3, "d6_event_study": q_d6}
    times = {}
    for name, fn in queries.items():
        if only and name not in only:
            continue
        fn()  # warm-up
        runs = []
        for _ in range(repeats):
            t0 = time.perf_counter()
            fn()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), "repeats": repeats}))


if __name__ == "__main__":
    main()
