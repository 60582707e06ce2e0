"""Exact k-nearest-neighbour join by pivots, for profiles with missing features.

Over the features that two profiles share, the distance obeys the triangle inequality.
A cohort's controls are dealt by hash over salts of bounded size and its treated units over parts, by their measured
numbers, and every part meets every salt in one task (``cogroup``), so no pair of a unit and a cell or
control is ever shuffled or stored.  There controls with the same features present (one *mask*) are dealt over cells around
pivots; a cell knows its number of controls and its radius.
For a treated unit whose features shared with a cell's mask lie at distance ``d`` from its pivot,
every control of the cell is at ``d - radius`` to ``d + radius`` (a radius over all features of the mask
bounds that over some).  Two rounds, for leaves of similar treated units:

1. the cell of the least upper bound that holds more than ``k`` controls is compared in full, which
   gives a k-th distance that the result can't exceed;
2. of the other cells, only those whose lower bound is within the k-th distance found so far are compared.

Cells that most units of a leaf need are compared at once by one matrix product, which is within its rounding a lower
bound; the pairs within the k-th distance, a few of them, are then measured feature by feature as the SQL expression does.
Where no bound prunes (many independent features) this still looks at every pair, in blocks of bounded size, and
keeps ``k`` rows of a unit and salt; the result is the same to the last tie.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kwhlens.operators.band_knn import _leaves, _needed, deal
from kwhlens.session import Scratch

#: Allowance for rounding when bounds are compared.
SLACK = 1e-9
#: The same for sums of squares, relative to the squares themselves.
SQUARE_SLACK = 1e-12
#: Rows of a leaf of treated units; controls that a cell should hold at least; controls of a block; pairs measured at once.
TREATED_LEAF, CELL, BLOCK, PAIRS = 256, 64, 4096, 250_000
#: Controls of a block while a unit has not found ``k``, or where no matrix product can screen.
FULL_BLOCK = 512
#: Profiles with a larger value (or one that is no number) are compared pair by pair.
LARGEST = 1e100
_UNKNOWN = 1e300


def _ordinary(x: np.ndarray) -> np.ndarray:
    """Rows whose squares stay far from the end of the doubles."""
    return ~(~(np.abs(x) <= LARGEST)).any(1)


class _Cells:
    """Controls in the order of their cells.  ``row`` is their original row number, which settles ties.

    About √n pivots per mask, drawn at random.  Controls of rare masks, and those of huge or missing numbers, come in *loose* cells, of
    which nothing is known: their radius is infinite.
    """

    def __init__(self, x: np.ndarray, mask: np.ndarray, key: np.ndarray):
        ordinary = _ordinary(x)
        draw, loose, cells, pivot, radius = np.random.default_rng(len(x)), [], [], [], []
        packed = np.packbits(mask, axis=1)
        _, code = np.unique(packed.view(np.dtype((np.void, packed.shape[1])))[:, 0], return_inverse=True)
        code[~ordinary] = -1
        by_mask = np.argsort(code, kind="stable")
        for rows in np.split(by_mask, np.flatnonzero(np.diff(code[by_mask])) + 1):
            if code[rows[0]] < 0 or len(rows) < CELL:
                loose.append(rows)
                continue
            at = np.sort(draw.choice(rows, max(1, min(int(np.sqrt(len(rows))), len(rows) // CELL)), replace=False))
            own = np.concatenate([np.argmin((x[at] ** 2).sum(1) - 2 * x[part] @ x[at].T, 1) for part in np.split(
                rows, range(BLOCK, len(rows), BLOCK))])
            far = np.sqrt(((x[rows] - x[at[own]]) ** 2).sum(1))
            by_cell = np.argsort(own, kind="stable")
            for members in np.split(by_cell, np.flatnonzero(np.diff(own[by_cell])) + 1):
                cells.append(rows[members])
                pivot.append(at[own[members[0]]])
                radius.append(far[members].max() * (1 + SLACK))
        if loose:
            rows = np.concatenate(loose)
            for part in (rows[ordinary[rows]], rows[~ordinary[rows]]):  # a loose cell is of one kind
                for block in np.split(part, range(FULL_BLOCK, len(part), FULL_BLOCK)) if len(part) else ():
                    cells.append(block)
                    pivot.append(block[0])
                    radius.append(np.inf)
        self.row = np.concatenate(cells)
        self.size = np.array([len(rows) for rows in cells])
        self.start = np.cumsum(self.size) - self.size
        self.radius, self.odd = np.array(radius), ~ordinary[pivot]
        self.px = np.where(self.odd[:, None], 0.0, x[pivot])
        self.pm = mask[pivot].astype(float)
        self.x, self.mask, self.key = x[self.row], mask[self.row], key[self.row]
        self.by_feature, self.present = np.ascontiguousarray(self.x.T), np.ascontiguousarray(self.mask.T)
        squares = np.where(ordinary[self.row, None], self.x, 0.0) ** 2 * (1 - SQUARE_SLACK)
        self.screen = np.hstack([self.mask, squares, self.x, np.ones((len(self.row), 1))])
        self.least = int(self.mask.sum(1).min())

    def members(self, cell: int) -> np.ndarray:
        return np.arange(self.start[cell], self.start[cell] + self.size[cell])


class _Leaf:
    """Some treated units and the ``k`` nearest controls that they have found."""

    def __init__(self, x: np.ndarray, mask: np.ndarray, key: np.ndarray, cells: _Cells, k: int, least: int, per_feature: bool):
        self.x, self.mask, self.key, self.cells, self.k = x, mask, key, cells, k
        self.least, self.per_feature = least, per_feature
        self.odd = not _ordinary(x).all()
        self.best = np.full(len(x), np.inf)
        self.u, self.c, self.v = (np.empty(0, np.int64) for _ in range(3))
        self.d = np.empty(0)
        self.pairs = np.zeros((2, len(x)), np.int64)
        #: every pair with a control shares so many features
        self.always = int(mask.sum(1).min()) + cells.least - mask.shape[1] >= least

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Lower bound and rough upper bound per unit and cell; infinite where the cell can't hold a match."""
        cells, m = self.cells, self.mask.astype(float)
        if self.odd:
            none = np.zeros((len(m), len(cells.size)))
            return none, none + np.inf
        shared = m @ cells.pm.T
        squares = (self.x ** 2 * (1 - SQUARE_SLACK)) @ cells.pm.T + m @ (cells.px ** 2 * (1 - SQUARE_SLACK)).T - 2 * self.x @ cells.px.T
        d, scale = np.sqrt(np.maximum(squares, 0)), np.sqrt(np.maximum(shared, 1)) if self.per_feature else 1.0
        low, high = np.maximum(d - cells.radius, 0) * (1 - SLACK) / scale, (d + cells.radius) / scale
        unfit = (shared < self.least) & np.isfinite(cells.radius)
        return np.where(unfit, np.inf, low), np.where(unfit | (cells.size <= self.k), np.inf, high)

    def compare(self, units: np.ndarray, rows: np.ndarray, odd: bool, part: int) -> None:
        self.pairs[part, units] += len(rows)
        at = 0
        while at < len(rows):
            whole = odd or self.odd or np.isinf(self.best[units]).any()
            some = rows[at:at + (FULL_BLOCK if whole else BLOCK)]
            at += len(some)
            self._compare(units, some, odd or self.odd)

    def _compare(self, units: np.ndarray, rows: np.ndarray, all_pairs: bool) -> None:
        cells, m = self.cells, self.mask[units].astype(float)
        near = None
        if not all_pairs:
            x, best = self.x[units], self.best[units]
            limit = np.minimum(np.where(np.isfinite(best), best, np.inf) ** 2 * (1 + SQUARE_SLACK), _UNKNOWN)[:, None]
            squares, none = x ** 2 * (1 - SQUARE_SLACK), np.zeros((len(units), 1))
            left = [squares - limit * m, m, -2 * x, none] if self.per_feature else [squares, m, -2 * x, -limit]
            near = np.hstack(left) @ cells.screen[rows].T <= 1e-300
        if all_pairs or not self.always:
            valid = m.astype(np.float32) @ cells.mask[rows].astype(np.float32).T >= self.least
            near = valid if near is None else near & valid
        found = np.flatnonzero(near)
        for part in np.split(found, range(PAIRS, len(found), PAIRS)):
            u, c = np.divmod(part, len(rows))
            self._measure(units[u], rows[c])

    def _measure(self, u: np.ndarray, c: np.ndarray) -> None:
        differ = self.key[u] != self.cells.key[c]
        u, c = u[differ], c[differ]
        if not len(u):
            return
        squares, valid = np.zeros(len(u)), np.zeros(len(u), np.int64)
        for f in range(self.x.shape[1]):
            both = self.mask[u, f] & self.cells.present[f, c]
            d = self.x[u, f] - self.cells.by_feature[f, c]
            squares += np.where(both, d * d, 0.0)
            valid += both
        d = np.sqrt(squares / valid) if self.per_feature else np.sqrt(squares)
        kept = ~(d > self.best[u])
        u, c, v, d = (np.concatenate(p) for p in ((self.u, u[kept]), (self.c, c[kept]), (self.v, valid[kept]), (self.d, d[kept])))
        row = self.cells.row[c]
        order = np.lexsort((row, d, u))
        # a block may hold the cell that some of its units have been compared with before
        again = (np.diff(u[order], prepend=-1) == 0) & (np.diff(row[order], prepend=-1) == 0)
        order = order[~again]
        rank = np.arange(len(order)) - np.searchsorted(u[order], u[order])
        order = order[rank < self.k]
        self.u, self.c, self.v, self.d = u[order], c[order], v[order], d[order]
        last = np.flatnonzero(rank[rank < self.k] == self.k - 1)
        found = self.d[last]
        self.best[self.u[last]] = np.where(np.isnan(found), np.inf, found)

    def search(self) -> None:
        cells, units = self.cells, np.arange(len(self.x))
        low, high = self.bounds()
        first = np.argmin(high, 1)
        known = np.isfinite(high[units, first])
        for i in np.unique(first[known]):
            own = np.flatnonzero(known & (first == i))
            self.compare(own, cells.members(i), False, 0)
            low[own, i] = np.inf
        # odd cells last: a number that they are compared with is found before
        order = np.lexsort((low.min(0), cells.odd))
        upto = np.cumsum(cells.size[order]) // BLOCK
        for some in np.split(order, np.flatnonzero(np.diff(upto)) + 1):
            alive = np.isfinite(low[:, some]) & (low[:, some] <= self.best[:, None])
            own, some, wanted = np.flatnonzero(alive.any(1)), some[alive.any(0)], alive.sum(0)[alive.any(0)]
            if not len(own):
                continue
            size = cells.size[some]
            if not cells.odd[some].any() and 2 * (wanted @ size) >= len(own) * size.sum():
                self.compare(own, np.concatenate([cells.members(i) for i in some]), False, 1)
                continue
            for i in some:
                near = np.flatnonzero(np.isfinite(low[:, i]) & (low[:, i] <= self.best))
                if len(near):
                    self.compare(near, cells.members(i), bool(cells.odd[i]), 1)


def nearest_rows(tx: np.ndarray, tm: np.ndarray, t_key: np.ndarray, cx: np.ndarray, cm: np.ndarray, c_key: np.ndarray,
                 k: int, min_valid: int, per_feature: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(treated row, control row, features shared, distance, pairs): the ``k`` nearest controls of each treated row.

    ``tm`` and ``cm`` say which features are there; rows of equal keys are the same unit and no pair.  Controls come in order of
    their ids, which settles ties; distances that are not a number come last.  ``pairs`` holds the pairs compared per
    round and treated row.
    """
    pairs = np.zeros((2, len(tx)), np.int64)
    none = np.empty(0, np.int64)
    out = [(none, none, none, np.empty(0))]
    if len(tx) and len(cx):
        tx, cx = np.where(tm, tx, 0.0), np.where(cm, cx, 0.0)
        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            needed = _needed(np.hstack([cx, cm]), np.zeros(len(cx)), c_key, k)
            cells = _Cells(cx[needed], cm[needed], c_key[needed])
            ordinary = _ordinary(tx)
            for part in (np.flatnonzero(ordinary), np.flatnonzero(~ordinary)):
                for rows in _leaves(np.where(tm, tx, np.nan)[part], TREATED_LEAF):
                    own = part[rows]
                    leaf = _Leaf(tx[own], tm[own], t_key[own], cells, k, max(1, min_valid), per_feature)
                    leaf.search()
                    pairs[:, own] = leaf.pairs
                    out.append((own[leaf.u], needed[cells.row[leaf.c]], leaf.v, leaf.d))
    return *(np.concatenate(p) for p in zip(*out)), pairs


def _nearest_map(features: Sequence[str], k: int, min_valid: int, per_feature: bool):
    def columns(t: pa.Table, side: str) -> tuple[np.ndarray, np.ndarray]:
        own = [t[f"{side}_{f}"] for f in features]
        return np.column_stack([x.to_numpy() for x in own]), np.column_stack([x.is_valid().to_numpy() for x in own])

    def fn(t: pa.Table, c: pa.Table) -> pa.Table:
        c = c.sort_by("c_id")
        ids = pc.unique(c["c_id"])
        t_key = pc.index_in(t["t_id"], value_set=ids).fill_null(-1).to_numpy()
        c_key = pc.index_in(c["c_id"], value_set=ids).to_numpy()
        u, v, valid, distance, pairs = nearest_rows(*columns(t, "t"), t_key, *columns(c, "c"), c_key, k, min_valid, per_feature)
        part, unit = np.nonzero(pairs)
        every = pa.array(np.concatenate([u, unit]))
        n, more = len(u), len(unit)
        return pa.table({
            "Ti": t["t_Ti"].take(every), "t_id": t["t_id"].take(every),
            "c_id": pa.chunked_array([*c["c_id"].take(pa.array(v)).chunks, pa.nulls(more, c["c_id"].type)], c["c_id"].type),
            "valid_dim": pa.array(np.concatenate([valid, np.zeros(more, np.int64)]), pa.int32()),
            "distance": pa.array(np.concatenate([distance, np.zeros(more)]), pa.float64()),
            "round": pa.array(np.concatenate([np.zeros(n, np.int64), part + 1]), pa.int32()),
            "pairs": pa.array(np.concatenate([np.zeros(n, np.int64), pairs[part, unit]]), pa.int64())})

    return fn


def nearest_controls(t: DataFrame, c: DataFrame, features: Sequence[str], k: int, min_valid: int = 0,
                     per_feature: bool = False, rows_per_salt: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(matches, compared): the ``k`` nearest controls of each treated unit, and the pairs compared per round.

    ``t`` and ``c`` have Ti, id and the features (NULL where missing).  Pairs of the same cohort and different
    ids that share at least ``min_valid`` features count; the distance is the root of the sum of squares
    over them, divided by their number if ``per_feature``.  Ties go to the smaller control id.  ``matches`` has Ti,
    t_id, c_id, valid_dim, distance, match_rank; ``compared`` has round, treated and pairs.
    """
    left, right = deal(t.where("id IS NOT NULL"), c.where("id IS NOT NULL"), features, rows_per_salt)
    kinds = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    found = left.groupBy("t_Ti", "_parts", "_salts").cogroup(right.groupBy("c_Ti", "_parts", "_salts")).applyInArrow(
        _nearest_map(features, k, min_valid, per_feature),
        f"Ti {kinds['t_Ti']}, t_id {kinds['t_id']}, c_id {kinds['t_id']}, valid_dim int, distance double, round int, pairs long")
    found = Scratch(t.sparkSession, "pivots").table(found, "found")
    order = Window.partitionBy("Ti", "t_id").orderBy("distance", "c_id")
    matches = found.where("round = 0").select(
        "Ti", "t_id", "c_id", "valid_dim", "distance", F.row_number().over(order).alias("match_rank")).where(
        F.col("match_rank") <= k)
    report = found.where("round > 0").groupBy("round").agg(
        F.count_distinct("Ti", "t_id").alias("treated"), F.sum("pairs").alias("pairs"))
    return matches, report
