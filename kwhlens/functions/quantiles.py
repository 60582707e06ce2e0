"""Exact quantiles per group without a sorted group in one task.

The values are counted, dealt into bins by approximate quantiles, and only the
bins that hold a wanted rank are ordered; ties are one counted value, so a bin
never holds more than its share of distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 256


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float],
                    interpolate: bool = False, bins: int = BINS) -> DataFrame:
    """``keys`` + ``n`` + one column ``q0, q1, …`` per quantile.

    Without interpolation a quantile is the smallest value whose share of the
    values up to it reaches q; with it, the linear interpolation at position
    q * (n - 1).  NULL values don't count.
    """
    k = list(keys)
    data = df.where(F.col(value).isNotNull()).select(*k, F.col(value).cast("double").alias("_v"))
    grid = [i / bins for i in range(1, bins)]
    edges = data.groupBy(*k).agg(F.percentile_approx("_v", grid, 20 * bins).alias("_e"))
    counts = data.groupBy(*k, "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = (counts.join(edges, k) if k else counts.crossJoin(F.broadcast(edges))).select(
        *k, "_v", "_c", F.size(F.filter("_e", lambda e: e < F.col("_v"))).alias("_b"))
    sizes = placed.groupBy(*k, "_b").agg(F.sum("_c").alias("_m"))
    group = Window.partitionBy(*k) if k else Window.partitionBy(F.lit(0))
    sizes = sizes.select(
        *k, "_b", "_m", F.sum("_m").over(group).alias("n"),
        (F.sum("_m").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")).alias("_before"))
    ranks = []
    for i, q in enumerate(qs):
        if interpolate:
            at = F.lit(float(q)) * (F.col("n") - 1)
            ranks += [F.struct(F.lit(2 * i).alias("i"), (F.floor(at) + 1).alias("r")),
                      F.struct(F.lit(2 * i + 1).alias("i"), (F.ceil(at) + 1).alias("r"))]
        else:
            ranks.append(F.struct(F.lit(i).alias("i"),
                                  F.greatest(F.lit(1), F.ceil(F.lit(float(q)) * F.col("n"))).alias("r")))
    wanted = sizes.select(*k, "_b", "_m", "n", "_before", F.explode(F.array(*ranks)).alias("_w")).where(
        "_w.r > _before and _w.r <= _before + _m").select(
        *k, "_b", "n", F.col("_w.i").alias("_i"), (F.col("_w.r") - F.col("_before")).alias("_r"))
    run = Window.partitionBy(*k, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = placed.join(F.broadcast(wanted) if not k else wanted, [*k, "_b"]).withColumn(
        "_up", F.sum("_c").over(run)).where("_up >= _r").groupBy(*k, "_i", "n").agg(F.min("_v").alias("_v"))

    def pick(i):
        return F.max(F.when(F.col("_i") == i, F.col("_v")))

    if not interpolate:
        return found.groupBy(*k, "n").agg(*[pick(i).alias(f"q{i}") for i in range(len(qs))])
    wide = found.groupBy(*k, "n").agg(*[pick(i).alias(f"_{i}") for i in range(2 * len(qs))])
    out = []
    for i, q in enumerate(qs):
        at = F.lit(float(q)) * (F.col("n") - 1)
        low, high = F.col(f"_{2 * i}"), F.col(f"_{2 * i + 1}")
        out.append((low + (high - low) * (at - F.floor(at))).alias(f"q{i}"))
    return wide.select(*k, "n", *out)
