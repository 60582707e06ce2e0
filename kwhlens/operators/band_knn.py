"""Exact k nearest controls within a band of one feature, without comparing all pairs.

A cohort's controls are dealt by hash over salts of bounded size and its treated units over parts, by their
measured numbers; every part meets every salt in one task (``cogroup``).  There both sides are halved along
their widest feature until small, which gives leaves with a box each.  A leaf of treated units is compared with the
leaves of controls in order of the distance of their boxes, and stops where that distance exceeds the
k-th distance that each of its units has found.  So a unit meets a few leaves per salt, and k rows per unit
and salt are left for the final order, instead of all pairs in the band.  Of controls with the same values only as
many are searched as can be among the k nearest, so ties don't grow with the number of copies.

Distances are summed feature by feature as the SQL expression does, so both give the same doubles.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a leaf of controls and of treated units.
CONTROL_LEAF, TREATED_LEAF = 256, 64
#: Controls of a salt per treated units of a part: the search in a salt grows far slower than its controls (7 MB per 100,000).
CONTROLS_PER_TREATED = 5
#: Allowance for rounding when bounds are compared.
SLACK = 1e-9


def _leaves(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Ascending row numbers of ``x`` per leaf; a leaf has at most ``size`` rows."""
    at = np.nan_to_num(x, nan=np.finfo(float).max)
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            if len(rows):
                out.append(rows)
            continue
        own = at[rows]
        # halved before subtracting: the span of two huge values stays finite
        widest = np.argmax(own.max(0) / 2 - own.min(0) / 2)
        order = np.argpartition(own[:, widest], len(rows) // 2)
        todo += [np.sort(rows[order[:len(rows) // 2]]), np.sort(rows[order[len(rows) // 2:]])]
    return out


def _boxes(x: np.ndarray, leaves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([x[rows].min(0) for rows in leaves]), np.array([x[rows].max(0) for rows in leaves])


def _needed(x: np.ndarray, b: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Ascending row numbers of the controls that can be among the ``k`` nearest of any unit.

    Rows of equal values have equal distances, so they are taken in their order, without those of the unit's own key.
    Of such rows ``k`` of a key and ``2 * k`` in all serve every unit, however many copies there are.
    """
    values = np.ascontiguousarray(np.column_stack([x, b]), dtype=float)
    _, point = np.unique(values.view(np.dtype((np.void, values.itemsize * values.shape[1])))[:, 0], return_inverse=True)

    def first(groups: Sequence[np.ndarray], most: int) -> np.ndarray:
        order = np.lexsort(groups)  # stable: rows of a group stay in their order
        starts = np.flatnonzero(np.any([np.diff(g[order], prepend=g[order[:1]] - 1) != 0 for g in groups], axis=0))
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
        return np.sort(order[rank < most])

    rows = first([key, point], k)
    return rows[first([point[rows]], 2 * k)]


def nearest_rows(tx: np.ndarray, tb: np.ndarray, t_key: np.ndarray, cx: np.ndarray, cb: np.ndarray, c_key: np.ndarray,
                 k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(treated row, control row, distance) of the ``k`` nearest controls of each treated row, and the pairs compared.

    ``tx`` and ``cx`` hold the features, ``tb`` and ``cb`` the raw values of the band ``|cb - tb| <= threshold * |tb|``;
    rows of equal keys are the same unit and no pair.  Controls come in order of their ids, which settles ties;
    distances that are not a number come last.
    """
    found, compared = [], 0
    if not len(cx):
        none = np.empty(0, np.int64)
        return none, none, np.empty(0), 0
    needed = _needed(cx, cb, c_key, k)
    cx, cb, c_key = cx[needed], cb[needed], c_key[needed]
    leaves = _leaves(cx, CONTROL_LEAF)
    low, high = _boxes(cx, leaves)
    b_low, b_high = (b[:, 0] for b in _boxes(cb[:, None], leaves))
    with np.errstate(invalid="ignore", over="ignore"):
        for own in _leaves(tx, TREATED_LEAF):
            x, b, key = tx[own], tb[own], t_key[own]
            width = threshold * np.abs(b)
            squares = np.zeros((len(own), len(leaves)))
            for f in range(cx.shape[1]):
                gap = np.maximum(0.0, np.maximum(low[:, f] - x[:, f, None], x[:, f, None] - high[:, f]))
                squares += np.nan_to_num(gap * gap, nan=0.0, posinf=np.inf)  # a box with a missing number has no bound
            bound = np.sqrt(squares) * (1 - SLACK)
            reach = (width * (1 + SLACK) + np.abs(b) * SLACK)[:, None]
            bound[(b_low > b[:, None] + reach) | (b_high < b[:, None] - reach)] = np.nan  # out of the band
            least = np.where(np.isnan(bound), np.inf, bound).min(0)
            best = np.full((len(own), k), np.inf)
            parts = []
            for i in np.argsort(least, kind="stable"):
                if least[i] > best[:, -1].max():
                    break
                near = np.flatnonzero(bound[:, i] <= best[:, -1])
                if not len(near):
                    continue
                rows = leaves[i]
                squares = np.zeros((len(near), len(rows)))
                for f in range(cx.shape[1]):
                    d = x[near, f, None] - cx[rows, f]
                    squares += d * d
                distance = np.sqrt(squares)
                pair = (np.abs(cb[rows] - b[near, None]) <= width[near, None]) & (key[near, None] != c_key[rows])
                compared += pair.size
                by = np.where(pair & ~np.isnan(distance), distance, np.inf)
                best[near] = np.sort(np.partition(np.hstack([best[near], by]), k - 1, axis=1)[:, :k], axis=1)
                u, c = np.nonzero(pair & (by <= best[near, -1:]))
                parts.append((near[u], rows[c], distance[u, c]))
            if parts:
                u, c, d = (np.concatenate(p) for p in zip(*parts))
                kept = ~(d > best[u, -1])
                u, c, d = u[kept], c[kept], d[kept]
                order = np.lexsort((c, d, u))
                u, c, d = u[order], c[order], d[order]
                first = np.searchsorted(u, u)
                kept = np.arange(len(u)) - first < k
                found.append((own[u[kept]], needed[c[kept]], d[kept]))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0), compared
    return *(np.concatenate(p) for p in zip(*found)), compared


def _nearest_map(features: Sequence[str], block: str, k: int, threshold: float):
    def columns(t: pa.Table, side: str) -> tuple[np.ndarray, np.ndarray]:
        x = np.column_stack([t[f"{side}_{f}"].to_numpy() for f in features])
        return x, t[f"{side}_{block}"].to_numpy()

    def fn(t: pa.Table, c: pa.Table) -> pa.Table:
        c = c.sort_by("c_id")
        t_key = pc.index_in(t["t_id"], value_set=pc.unique(c["c_id"])).fill_null(-1).to_numpy()
        c_key = pc.index_in(c["c_id"], value_set=pc.unique(c["c_id"])).to_numpy()
        u, v, distance, _ = nearest_rows(*columns(t, "t"), t_key, *columns(c, "c"), c_key, k, threshold)
        return pa.table({"Ti": t["t_Ti"].take(pa.array(u)), "t_id": t["t_id"].take(pa.array(u)),
                         "c_id": c["c_id"].take(pa.array(v)), "distance": pa.array(distance, pa.float64())})

    return fn


def deal(t: DataFrame, c: DataFrame, columns: Sequence[str], rows_per_salt: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with Ti, id and ``columns`` (prefixed), dealt so that every part meets every salt of its cohort once."""
    rows = max(1, int(rows_per_salt))

    def sized(df: DataFrame, name: str, most: int) -> DataFrame:
        return df.groupBy("Ti").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))

    # one row per cohort (adoption dates: bounded by the calendar)
    dealt = F.broadcast(sized(t, "_parts", rows).join(sized(c, "_salts", CONTROLS_PER_TREATED * rows), "Ti"))

    def side(df: DataFrame, name: str, own: str, other: str) -> DataFrame:
        return df.join(dealt, "Ti").select(
            F.col("Ti").alias(f"{name}_Ti"), F.col("id").alias(f"{name}_id"),
            *[F.col(x).alias(f"{name}_{x}") for x in dict.fromkeys(columns)],
            F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))

    return side(t, "t", "_parts", "_salts"), side(c, "c", "_salts", "_parts")


def nearest_in_band(t: DataFrame, c: DataFrame, features: Sequence[str], block: str, k: int, threshold: float,
                    rows_per_salt: int) -> DataFrame:
    """``Ti, t_id, c_id, distance``: of each salt and treated row the ``k`` nearest controls of its cohort in the band.

    ``t`` and ``c`` have Ti, id, the features and ``block``, none NULL.  A caller keeps the k least per unit.
    """
    left, right = deal(t, c, [*features, block], rows_per_salt)
    kinds = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    return left.groupBy("t_Ti", "_parts", "_salts").cogroup(right.groupBy("c_Ti", "_parts", "_salts")).applyInArrow(
        _nearest_map(features, block, k, threshold),
        f"Ti {kinds['t_Ti']}, t_id {kinds['t_id']}, c_id {kinds['t_id']}, distance double")
