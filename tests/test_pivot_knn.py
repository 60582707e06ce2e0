"""The pivot join against all pairs: ties, missing features, units in both roles, few controls, and how much it prunes."""

import math
import random

import pytest

from kwhlens.operators import matching as N
from kwhlens.operators.pivot_knn import nearest_controls

FEATURES = ["a", "b", "c", "d"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "Ti int, id string, a double, b double, c double, d double")


def plain(t, c, k, min_valid, per_feature):
    out = []
    for ti, i, *x in t:
        found = []
        for cti, j, *y in c:
            both = [(p - q) ** 2 for p, q in zip(x, y) if p is not None and q is not None]
            if cti == ti and i != j and len(both) >= max(1, min_valid):
                found.append((math.sqrt(sum(both) / (len(both) if per_feature else 1)), j, len(both)))
        found.sort()
        out += [(ti, i, j, v, r + 1) for r, (_, j, v) in enumerate(found[:k])]
    return sorted(out)


def units(n, seed, missing, grid, prefix=""):
    r = random.Random(seed)
    return [(r.randrange(2), f"{prefix}{i}", *[
        None if r.random() < missing else float(r.randrange(4)) if grid else r.gauss(0, 1) + 8 * (i % 5) for _ in FEATURES])
        for i in range(n)]


@pytest.mark.parametrize("missing, grid, k, min_valid, per_feature", [
    (0.0, True, 3, 0, False), (0.3, True, 3, 2, True), (0.5, False, 5, 2, True), (0.0, False, 4, 0, False), (0.9, True, 2, 1, True)])
def test_equals_all_pairs(spark, missing, grid, k, min_valid, per_feature):
    t, c = units(25, 1, missing, grid), units(120, 2, missing, grid)  # ids overlap: units in both roles
    c += [(5, "alone", 1.0, 1.0, 1.0, 1.0)]
    t += [(5, "one", 1.0, 2.0, 1.0, 1.0), (9, "none", 1.0, 1.0, 1.0, 1.0)]
    matches, _ = nearest_controls(frame(spark, t), frame(spark, c), FEATURES, k, min_valid, per_feature, rows_per_salt=40)
    got = sorted((r.Ti, r.t_id, r.c_id, r.valid_dim, r.match_rank) for r in matches.collect())
    assert got == plain(t, c, k, min_valid, per_feature)


def test_few_pairs_are_compared(spark):
    """Groups of similar units: of 100 x 2000 pairs only a few per cent are compared."""
    t, c = units(100, 3, 0.0, False, "t"), units(2000, 4, 0.0, False, "c")
    matches, report = nearest_controls(frame(spark, t), frame(spark, c), FEATURES, 5)
    pairs = sum(1 for x in t for y in c if x[0] == y[0])
    compared = sum(r.pairs for r in report.collect())
    assert sorted((r.Ti, r.t_id, r.c_id, r.valid_dim, r.match_rank) for r in matches.collect()) == plain(t, c, 5, 0, False)
    assert compared < 0.3 * pairs


def test_switch_by_measured_pairs(spark, monkeypatch):
    rows = [(1, f"t{i}", "treated", float(i)) for i in range(5)] + [(1, f"c{i}", "control", i * 0.7) for i in range(20)]
    pz = spark.createDataFrame(rows, "Ti int, id string, `group` string, x_z double")
    want = sorted(map(tuple, N.match_topk(pz, ["x"], 3, use_peak_blocking=False, prune=False).collect()))
    assert not N._by_pivots(pz, None)
    monkeypatch.setattr(N, "PLAIN_PAIRS", 99)
    assert N._by_pivots(pz, None)
    assert sorted(map(tuple, N.match_topk(pz, ["x"], 3, use_peak_blocking=False).collect())) == want


def test_empty_sides(spark):
    t = frame(spark, units(3, 1, 0.0, True))
    assert nearest_controls(t, t.where("Ti > 99"), FEATURES, 2)[0].count() == 0
    assert nearest_controls(t.where("Ti > 99"), t, FEATURES, 2)[0].count() == 0
