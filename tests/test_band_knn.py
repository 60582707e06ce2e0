"""Blocked matching against all pairs (ties, units in both roles, narrow bands), and how much the boxes prune."""

import math
import random

import numpy as np
import pytest

from kwhlens.operators import matching as N
from kwhlens.operators.band_knn import nearest_rows


def distance(x, y):
    total = 0.0  # one after the other: sum() compensates
    for p, q in zip(x, y):
        total += (p - q) * (p - q)
    return math.sqrt(total)


def plain(rows, k, thr):
    out = []
    for ti, i, group, b, *x in rows:
        if group == "treated" and i is not None and None not in (b, *x):
            found = sorted((distance(x, y), j) for tj, j, g, cb, *y in rows
                           if g == "control" and tj == ti and j not in (None, i) and None not in (cb, *y)
                           and abs(cb - b) <= thr * abs(b))
            out += [(i, j, ti, d, r + 1) for r, (d, j) in enumerate(found[:k])]
    return sorted(out)


def units(n, seed, group, grid):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x = [float(r.randrange(3)) if grid else r.gauss(0, 1) for _ in range(3)]
        out.append((r.randrange(2), None if r.random() < 0.03 else f"{i}", group, None if r.random() < 0.05 else x[0] + 1,
                    x[0], x[1], None if r.random() < 0.05 else x[2]))
    return out


@pytest.mark.parametrize("grid, k, thr", [(True, 4, 0.3), (True, 2, 1.2), (False, 5, 0.3), (False, 3, 0.01)])
def test_equals_all_pairs(spark, grid, k, thr):
    # ids overlap: units in both roles
    rows = units(150, 1, "treated", grid) + units(700, 2, "control", grid) + [(7, "alone", "treated", 1.0, 1.0, 1.0, 1.0)]
    pz = spark.createDataFrame(rows, "Ti int, id string, `group` string, peak_mean double, peak_mean_z double, y_z double, z_z double")
    got = N.match_topk(pz, ["peak_mean", "y", "z"], k, thr, rows_per_salt=60)
    assert sorted(map(tuple, got.select(
        "treated_id", "control_id", "adoption_month", "distance", "match_rank").collect())) == plain(rows, k, thr)


def test_few_pairs_are_compared():
    """The share of pairs compared falls as the cohort grows; listing the pairs of the band compares most of them."""
    r = np.random.default_rng(5)
    share = []
    for n in (2_000, 16_000):
        t, c = r.normal(size=(n // 4, 4)), r.normal(size=(n, 4))
        _, _, found, compared = nearest_rows(t, t[:, 0] + 10, np.full(len(t), -1), c, c[:, 0] + 10, np.arange(n), 5, 0.3)
        assert len(found) == 5 * len(t)
        share.append(compared / (len(t) * n))
    assert share[1] < 0.1 and share[1] < share[0] / 2


@pytest.mark.parametrize("copies", [3, 40])
def test_copies_do_not_multiply_the_pairs(copies):
    """Equal controls of many units, repeated keys and treated units that are controls too: all pairs' rows, few compared."""
    r = np.random.default_rng(3)
    points = r.normal(size=(30, 3))
    c = np.repeat(points, copies, axis=0)[r.permutation(30 * copies)]
    c_key = np.sort(r.integers(0, 20 * copies, len(c)))
    t_rows = np.arange(0, len(c), copies)
    t, t_key, k, thr = c[t_rows], c_key[t_rows], 4, 0.9
    u, v, d, _ = nearest_rows(t, t[:, 0], t_key, c, c[:, 0], c_key, k, thr)
    wanted = []
    for i in range(len(t)):
        near = sorted((distance(t[i], c[j]), int(c_key[j])) for j in range(len(c))
                      if c_key[j] != t_key[i] and abs(c[j, 0] - t[i, 0]) <= thr * abs(t[i, 0]))
        wanted += [(i, x, y) for x, y in near[:k]]
    assert sorted(zip(u.tolist(), d.tolist(), c_key[v].tolist())) == sorted(wanted)


def test_pairs_of_copies_are_bounded():
    """All controls alike: the pairs compared don't grow with their number."""
    _, v, _, compared = nearest_rows(np.zeros((100, 2)), np.ones(100), np.full(100, -1), np.zeros((5000, 2)), np.ones(5000),
                                     np.arange(5000), 5, 0.3)
    assert v.reshape(100, 5).tolist() == [[0, 1, 2, 3, 4]] * 100 and compared <= 100 * 10


def test_distances_that_are_no_numbers_come_last():
    c = np.array([[np.nan], [2.0], [np.inf], [1.0]])
    u, v, _, _ = nearest_rows(np.zeros((1, 1)), np.ones(1), np.array([-1]), c, np.ones(4), np.arange(4), 4, 0.3)
    assert u.tolist() == [0] * 4 and v.tolist() == [3, 1, 2, 0]
