"""Connected components of an edge table by alternating large-star / small-star rounds.

Every round is two grouped minima and two joins; the edge table is rewritten to
the shared folder, so the lineage stays short and a lost executor costs one
round.  Nothing but the round's checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kwhlens.session import Scratch

MAX_ROUNDS = 100


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
    return both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; root is the smallest node reachable.

    Roots themselves are listed too.  Self loops, repeated and reversed edges
    are allowed; an empty table gives an empty result.
    """
    current = scratch.table(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(),
        f"{label}0")
    before = None
    for i in range(1, MAX_ROUNDS + 1):
        seen = Observation(f"{scratch.path}-{label}{i}")
        step = _small_star(_large_star(current)).observe(
            seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
        following = scratch.table(step, f"{label}{i}")
        scratch.drop(f"{label}{i - 1}")
        current, mark = following, (seen.get["n"], seen.get["x"])
        if mark == before or mark[0] == 0:
            break
        before = mark
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
