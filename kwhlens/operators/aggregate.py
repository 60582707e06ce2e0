"""Household × period × price statistics of meter readings.

Plan shape (readings scanned once, contracts never joined to them):

1. readings → period → price period of each reading (not doubled);
2. **day rows**: one row per household, period and calendar day with count, sum, M2
   (= var_pop·n), max and the daily peak ``min(struct(kWh IS NULL, -kWh, ts))`` (largest kWh,
   earliest time on ties) of the high and the low price period side by side, and ``all`` merged
   from the two.  Partial aggregation runs map-side, so a hot household is
   pre-combined before the shuffle.  If quantiles are asked for, readings are first counted
   by value, and a day row also holds its (value, count) pairs;
3. the day rows of a household and period (bounded by the calendar) are gathered in
   one array, partitioned by household only, so every later step needs no further exchange;
4. contracts, one array of starts per household, are joined to these groups.  A day
   counts for the state without and with contract as often as it has such contracts, so
   several contracts multiply sums and counts but no rows;
5. sums add up, variances merge (Chan), the top-3 days are the first three of the sorted
   daily peaks, and a quantile is found by its rank among the counted values.

Only days on which a contract starts after midnight are read again at reading level, joined with
their contracts, and added as day rows of a known state; contract tables with dates have none.
Household totals (A9) are the sums of the day rows before the contracts count.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kwhlens.functions.quantiles import exact_quantiles
from kwhlens.operators.readings import (
    RAW_TARIFF_NAMES,
    add_period,
    add_price_period,
    attach_tariff,
    normalize_readings,
    normalize_tariff,
    plan_label,
)
from kwhlens.session import Scratch
from kwhlens.sources.readers import DEFAULT_HOLIDAYS

GROUP_KEYS = ["aID", "period", "price", "tariff_active"]
_QRE = re.compile(r"^q(\d+(?:\.\d+)?)$")


def _method_columns(m: str) -> list[str]:
    if m == "top3_mean":
        return [f"peak{i}_{k}" for i in (1, 2, 3) for k in ("time", "consumption")] + [
            "top3_mean_consumption"
        ]
    if m in ("sum", "mean", "variance", "median", "max"):
        return [f"{m}_consumption"]
    if _QRE.match(m):
        return [f"{m}_consumption"]
    raise ValueError(m)


def household_totals(readings: DataFrame) -> DataFrame:
    """Total kWh per household.

    A dedicated aggregate over the normalised readings: Parquet column
    pruning reads only ``aID`` and kWh, partial aggregation combines map-side,
    and each reading counts once even when a household has several contracts.
    """
    return readings.groupBy("aID").agg(F.sum("FORBRUKNING_KWH").alias("total_consumption"))


def usage_groups(
    totals: DataFrame,
    quantiles: Sequence[float] = (0.25, 0.75),
    mode: str = "exact",
    relative_error: float = 0.01,
) -> DataFrame:
    """Cut household totals at two quantiles → low / medium / high.

    The cut points are a one-row table joined back with a broadcast of that
    row: exact by counted bins (no task orders all households), or
    ``mode="approx"`` by a sketch of the given relative error.
    """
    q1, q2 = float(quantiles[0]), float(quantiles[1])
    if mode == "exact":
        cuts = exact_quantiles(totals, [], "total_consumption", [q1, q2]).select(
            F.col("q0").alias("_q1"), F.col("q1").alias("_q2"))
    else:
        acc = max(1, int(round(1.0 / relative_error)))
        qs = F.percentile_approx("total_consumption", [q1, q2], acc)
        cuts = totals.agg(qs.alias("_qs")).select(F.col("_qs")[0].alias("_q1"), F.col("_qs")[1].alias("_q2"))
    t = F.col("total_consumption")
    return totals.crossJoin(F.broadcast(cuts)).select(
        "aID",
        "total_consumption",
        F.when(t <= F.col("_q1"), "low").when(t <= F.col("_q2"), "medium").otherwise("high").alias("usage_group"),
    )


def tariff_info(tariff: DataFrame | None) -> DataFrame | None:
    """One contract per household — earliest start and its plan label.

    Computed from the contract table itself (not from a second pass over the
    readings); ties on the start date resolve to the smallest plan name.
    """
    if tariff is None:
        return None
    t = normalize_tariff(tariff)
    return t.groupBy("aID").agg(
        F.min("tariff_start").alias("tariff_start"),
        plan_label(F.min_by("tariff_plan", F.struct("tariff_start", "tariff_plan"))).alias("tariff_plan"),
    )


def contract_starts(tariff: DataFrame) -> DataFrame:
    """P3 as one row per household: ``contracts`` (their number) and ``starts`` (distinct start times and their numbers)."""
    per_start = normalize_tariff(tariff).groupBy("aID", "tariff_start").agg(F.count(F.lit(1)).alias("k"))
    return per_start.groupBy("aID").agg(
        F.sum("k").alias("contracts"),
        F.collect_list(F.when(F.col("tariff_start").isNotNull(), F.struct(F.col("tariff_start").alias("t"), "k"))).alias("starts"))


def starts_within_days(tariff: DataFrame) -> DataFrame | None:
    """(aID, _day) on which a contract starts after midnight; None if there are none.

    Contract tables with dates can't have any; of others the (small) table is looked at.
    """
    kinds = {RAW_TARIFF_NAMES.get(n, n): t for n, t in tariff.dtypes}
    if kinds.get("tariff_start") == "date":
        return None
    found = normalize_tariff(tariff).where("tariff_start <> date_trunc('DAY', tariff_start)").select(
        "aID", F.to_date("tariff_start").alias("_day")).distinct()
    return None if found.isEmpty() else found


#: Figures of a day row: readings, those with a value, their sum, M2 and maximum, the daily peak, the counted values.
FIGURES = ("rows", "n", "s", "m2", "mx", "pk", "vals")


def _figures_for(methods: Sequence[str]) -> list[str]:
    """The figures that the methods need; ``rows``, ``n`` and ``s`` always are."""
    need = {"rows", "n", "s"}
    for m in methods:
        need |= {"variance": {"m2"}, "max": {"mx"}, "top3_mean": {"pk"}, "sum": set(), "mean": set()}.get(m, {"vals"})
    return [f for f in FIGURES if f in need]


def day_rows(x: DataFrame, prices: Sequence[str], keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Step 2: a row per ``keys`` and day; the figures ``names`` of price ``p`` are the struct ``p``.

    The readings are not doubled for ``all``: each price's sums are conditional
    aggregates of the same row, and ``all`` is merged from high and low.
    """
    x = x.withColumn("_day", F.to_date("TIDPUNKT"))
    kwh = F.col("FORBRUKNING_KWH")
    day = [*keys, "_day"]

    def peak(own: Column, ts: Column) -> Column:
        return F.min(F.when(own, F.struct(kwh.isNull().alias("nul"), (-kwh).alias("negk"), ts.alias("ts"))))

    aggs, out = [], []
    if "vals" in names:
        counted = x.groupBy(*day, "FORBRUKNING_KWH").agg(*[c for p in prices for c in (
            F.count(F.when(F.col("price") == p, 1)).alias(f"_c_{p}"),
            F.min(F.when(F.col("price") == p, F.col("TIDPUNKT"))).alias(f"_t_{p}"))])
        for p in prices:
            c = F.col(f"_c_{p}")
            known = F.when((c > 0) & kwh.isNotNull(), c)
            aggs += [F.sum(c).alias(f"rows_{p}"), F.coalesce(F.sum(known), F.lit(0)).alias(f"n_{p}"),
                     F.sum(kwh * known).alias(f"s_{p}"), F.max(F.when(c > 0, kwh)).alias(f"mx_{p}"),
                     F.sort_array(F.collect_list(F.when(known.isNotNull(), F.struct(kwh.alias("v"), c.alias("c"))))).alias(f"vals_{p}"),
                     peak(c > 0, F.col(f"_t_{p}")).alias(f"pk_{p}")]
        days = counted.groupBy(*day).agg(*aggs).withColumns({f"m2_{p}": F.expr(
            f"aggregate(vals_{p}, 0D, (a, x) -> a + x.c * pow(x.v - s_{p} / n_{p}, 2))") for p in prices})
    else:
        for p in prices:
            own = F.col("price") == p
            mine = F.when(own, kwh)
            aggs += [F.count(F.when(own, 1)).alias(f"rows_{p}"), F.count(mine).alias(f"n_{p}"), F.sum(mine).alias(f"s_{p}"),
                     (F.var_pop(mine) * F.count(mine)).alias(f"m2_{p}"), F.max(mine).alias(f"mx_{p}"),
                     peak(own, F.col("TIDPUNKT")).alias(f"pk_{p}")]
        days = x.groupBy(*day).agg(*aggs)
    for p in prices:
        out.append(F.struct(*[F.col(f"{c}_{p}").alias(c) for c in names]).alias(p))
    if len(prices) == 2:
        a, b = ({c: F.col(f"{c}_{p}") for c in FIGURES} for p in prices)
        n = a["n"] + b["n"]
        gap = F.when((a["n"] > 0) & (b["n"] > 0),
                     a["n"] * b["n"] / n * F.pow(a["s"] / a["n"] - b["s"] / b["n"], 2))
        merged = {"rows": lambda: a["rows"] + b["rows"], "n": lambda: n, "s": lambda: F.coalesce(a["s"] + b["s"], a["s"], b["s"]),
                  "m2": lambda: F.when(n > 0, sum((F.coalesce(x, F.lit(0.0)) for x in (b["m2"], gap)),
                                                  F.coalesce(a["m2"], F.lit(0.0)))),
                  "mx": lambda: F.greatest(a["mx"], b["mx"]), "pk": lambda: F.least(a["pk"], b["pk"]),
                  "vals": lambda: F.concat(a["vals"], b["vals"])}
        out.append(F.struct(*[merged[c]().alias(c) for c in names]).alias("all"))
    return days.select(*day, *out)


def _state_rows(days: DataFrame, tariff: DataFrame | None) -> DataFrame:
    """Steps 3–4: (aID, period, tariff_active, w: array of (number of contracts, day), own: the household's kWh once).

    ``days`` has a column ``_state``: null for a whole day, else the state that its readings are in.
    """
    figures = [c for c in days.columns if c not in ("aID", "period")]
    groups = days.repartition("aID").groupBy("aID", "period").agg(
        F.sort_array(F.collect_list(F.struct("_day", "_state", *[c for c in figures if c not in ("_day", "_state")]))).alias("days"))
    if tariff is None:
        groups = groups.withColumns({"contracts": F.lit(None).cast("long"),
                                     "starts": F.expr("CAST(array() AS array<struct<t: timestamp_ntz, k: bigint>>)")})
    else:
        groups = groups.join(contract_starts(tariff), "aID", "left")
    begins = "CAST(d._day AS timestamp_ntz)"
    with_ = f"aggregate(filter(starts, s -> s.t <= {begins}), 0L, (a, s) -> a + s.k)"
    cut = f"exists(starts, s -> s.t > {begins} AND s.t < {begins} + INTERVAL '1' DAY)"

    def weighted(state: int, whole: str) -> str:
        w = f"CASE WHEN d._state IS NOT NULL THEN IF(d._state = {state}, 1L, 0L) WHEN coalesce({cut}, false) THEN 0L ELSE {whole} END"
        return (f"named_struct('tariff_active', {state}, 'w', filter(transform(days, d -> named_struct('w', {w}, 'd', d)), "
                f"x -> x.w > 0))")

    states = [weighted(0, f"coalesce(contracts - {with_}, 1L)"), weighted(1, f"coalesce({with_}, 0L)")]
    whole = "filter(days, d -> d._state IS NULL AND d.all.s IS NOT NULL)"
    own = f"IF(size({whole}) > 0, aggregate({whole}, 0D, (a, d) -> a + d.all.s), NULL)"
    return groups.select(
        "aID", "period", F.expr(own).alias("own"),
        F.posexplode(F.expr(f"filter(array({', '.join(states)}), x -> size(x.w) > 0)")).alias("_i", "_s")).select(
        "aID", "period", "_s.tariff_active", "_s.w", F.when(F.col("_i") == 0, F.col("own")).alias("own"))


def _merged(spread: bool) -> str:
    """Count, sum and (if asked for) M2 of the days ``_p.r``, one after the other."""
    gap = "IF(a.n > 0 AND x.n > 0, a.n * 1D * x.n / (a.n + x.n) * pow(a.s / a.n - x.s / x.n, 2), 0D)"
    first, more = (", 'm2', 0D", f", 'm2', a.m2 + coalesce(x.m2, 0D) + {gap}") if spread else ("", "")
    return (f"aggregate(_p.r, named_struct('n', 0L, 's', 0D{first}), (a, x) -> named_struct("
            f"'n', a.n + x.n, 's', a.s + coalesce(x.s, 0D){more}))")


def _rank_value(q: float) -> str:
    """The smallest value whose share of the values up to it reaches q, among the counted values of the days ``r``."""
    need = f"greatest(1L, CAST(ceil({q!r}D * t.n) AS BIGINT))"
    return ("aggregate(array_sort(flatten(transform(r, x -> transform(x.vals, y -> named_struct('v', y.v, 'c', y.c * x.w))))), "
            "named_struct('up', 0L, 'v', CAST(NULL AS DOUBLE)), (a, y) -> IF(a.up >= "
            f"{need}, a, named_struct('up', a.up + y.c, 'v', y.v)), a -> a.v)")


def aggregate_readings(
    readings: DataFrame,
    tariff: DataFrame | None = None,
    freq: str = "month",
    agg_method: str | Sequence[str] = "top3_mean",
    use_price: bool = True,
    add_user_group_col: Sequence[float] | None = None,
    holidays=DEFAULT_HOLIDAYS,
    usage_quantile_mode: str = "exact",
    usage_relative_error: float = 0.01,
) -> DataFrame:
    """The whole aggregation run as one plan.

    Output: ``aID, TIDPUNKT(period), price, tariff_active, <method columns in
    the order asked>, tariff_start, tariff_plan[, total_consumption,
    usage_group]``.  Unknown methods raise ``ValueError`` before any job.  Quantiles are exact.

    The plan is lazy, but for two things: of a contract table with times it is looked up whether any
    contract starts after midnight, and with usage groups the aggregated rows are written to the
    checkpoint folder, because the cuts need all households' totals first.
    """
    methods = [agg_method] if isinstance(agg_method, str) else list(agg_method)
    out_cols: list[str] = []
    for m in methods:
        out_cols += _method_columns(m)
    prices = ["high", "low"] if use_price else ["all"]
    names = _figures_for(methods)

    def priced(x: DataFrame) -> DataFrame:
        x = add_period(x, freq)
        return add_price_period(x, holidays) if use_price else x.withColumn("price", F.lit("all"))

    clean = normalize_readings(readings)
    days = day_rows(priced(clean), prices, ["aID", "period"], names).withColumn(
        "_state", F.lit(None).cast("int"))
    if tariff is not None and (parted := starts_within_days(tariff)) is not None:
        x = clean.withColumn("_day", F.to_date("TIDPUNKT")).join(parted, ["aID", "_day"])
        days = days.unionByName(day_rows(
            priced(attach_tariff(x, tariff)), prices, ["aID", "period", "tariff_active"], names
        ).withColumnRenamed("tariff_active", "_state"))
    states = _state_rows(days, tariff)
    every = ["all", "high", "low"] if use_price else ["all"]
    times = ("n", "s", "m2")  # these count once for each contract
    weigh = ", ".join(["'w', x.w"] + [f"'{c}', " + "x.w * " * (c in times) + f"{{0}}.{c}" for c in names if c != "rows"])
    by_price = ", ".join(
        f"named_struct('price', '{p}', 'r', transform(filter(w, x -> x.d.{p}.rows > 0), x -> named_struct("
        f"{weigh.format(f'x.d.{p}')})))" for p in every)
    rows = states.select(
        "aID", "period", "tariff_active", "own",
        F.posexplode(F.expr(f"filter(array({by_price}), x -> size(x.r) > 0)")).alias("_i", "_p")).select(
        "aID", "period", "_p.price", "tariff_active", "_p.r", F.when(F.col("_i") == 0, F.col("own")).alias("own"),
        F.expr(_merged("m2" in names)).alias("t"))

    cols: dict[str, str] = {}
    for m in methods:
        if m == "sum":
            cols["sum_consumption"] = "IF(t.n > 0, t.s, NULL)"
        elif m == "mean":
            cols["mean_consumption"] = "IF(t.n > 0, t.s / t.n, NULL)"
        elif m == "max":
            cols["max_consumption"] = "array_max(transform(r, x -> x.mx))"
        elif m == "variance":
            cols["variance_consumption"] = "IF(t.n > 1, t.m2 / (t.n - 1), NULL)"
        elif m != "top3_mean":
            cols[f"{m}_consumption"] = _rank_value(0.5 if m == "median" else float(_QRE.match(m).group(1)) / 100)
    if "pk" in names:
        rows = rows.withColumn("_top", F.expr("slice(sort_array(transform(r, x -> x.pk)), 1, 3)"))
        for i in (1, 2, 3):
            cols[f"peak{i}_time"] = f"get(_top, {i - 1}).ts"
            cols[f"peak{i}_consumption"] = f"-get(_top, {i - 1}).negk"
        cols["top3_mean_consumption"] = "(-get(_top, 0).negk - get(_top, 1).negk - get(_top, 2).negk) / 3"
    result = rows.select(*GROUP_KEYS, "own", *[F.expr(e).alias(c) for c, e in cols.items()])
    result = result.select(*GROUP_KEYS, *out_cols, "own").withColumnRenamed("period", "TIDPUNKT")

    info = tariff_info(tariff)
    if info is None:
        extra = {"tariff_start": F.lit(None).cast("timestamp_ntz"), "tariff_plan": F.lit(None).cast("string")}
    if add_user_group_col is None:
        result = result.drop("own")
        return result.withColumns(extra) if info is None else result.join(info, "aID", "left")
    result = Scratch(readings.sparkSession, "aggregate").table(result, "rows")
    usage = usage_groups(result.groupBy("aID").agg(F.sum("own").alias("total_consumption")), add_user_group_col,
                         usage_quantile_mode, usage_relative_error)
    result = result.drop("own")
    result = result.withColumns(extra) if info is None else result.join(info, "aID", "left")
    return result.join(usage, "aID", "left")


def run(readings: DataFrame, tariff: DataFrame | None = None, freq: str = "month",
        agg_method="top3_mean", use_price: bool = True, add_user_group_col=None,
        table_name: str | None = None, mode: str = "overwrite", fmt: str = "parquet",
        table_path: str | None = None, **kw) -> DataFrame:
    """A16 with the optional table sink."""
    result = aggregate_readings(readings, tariff, freq, agg_method, use_price, add_user_group_col, **kw)
    if table_name is not None:
        from kwhlens.sources.sinks import save_table

        save_table(result, table_name, fmt=fmt, mode=mode, path=table_path)
    return result
