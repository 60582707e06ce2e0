"""The pivot join where no bound prunes: all pairs' rows, no table or shuffle of pairs, profiles computed once."""

import math

import numpy as np
import pytest

from kwhlens.operators import matching as N
from kwhlens.operators import pivot_knn as PK


def all_pairs(tx, tm, t_key, cx, cm, c_key, k, min_valid, per_feature):
    out = []
    for i in range(len(tx)):
        found = []
        for j in range(len(cx)):
            total, valid = 0.0, 0
            for f in np.flatnonzero(tm[i] & cm[j]):
                total += (tx[i, f] - cx[j, f]) * (tx[i, f] - cx[j, f])
                valid += 1
            if valid >= max(1, min_valid) and t_key[i] != c_key[j]:
                d = math.sqrt(total / valid) if per_feature else math.sqrt(total)
                found.append((math.isnan(d), 0.0 if math.isnan(d) else d, j, valid))
        found.sort()
        out += [(i, j, v, None if nan else d) for nan, d, j, v in found[:k]]
    return out


def rows(n, dims, missing, seed, grid=False):
    r = np.random.default_rng(seed)
    x = r.integers(0, 4, (n, dims)).astype(float) if grid else r.normal(size=(n, dims))
    return x, r.random((n, dims)) >= missing


def searched(*args):
    u, v, valid, d, pairs = PK.nearest_rows(*args)
    order = np.lexsort((v, d, u))
    got = list(zip(u[order].tolist(), v[order].tolist(), valid[order].tolist(),
                   [None if math.isnan(x) else x for x in d[order].tolist()]))
    return got, pairs


@pytest.mark.parametrize("dims, missing, grid, k, min_valid, per_feature, block", [
    (8, 0.0, False, 5, 0, False, 4096), (8, 0.1, False, 3, 2, True, 300), (5, 0.5, True, 4, 3, True, 100),
    (3, 0.0, True, 2, 0, False, 64), (6, 0.7, False, 5, 4, True, 4096)])
def test_equals_all_pairs(monkeypatch, dims, missing, grid, k, min_valid, per_feature, block):
    monkeypatch.setattr(PK, "BLOCK", block)
    monkeypatch.setattr(PK, "TREATED_LEAF", 20)
    (tx, tm), (cx, cm) = rows(60, dims, missing, 1, grid), rows(700, dims, missing, 2, grid)
    t_key, c_key = np.arange(60) - 10, np.sort(np.arange(700) // 2)  # repeated controls, units in both roles
    args = tx, tm, t_key, cx, cm, c_key, k, min_valid, per_feature
    got, _ = searched(*args)
    assert got == all_pairs(*args)


def test_numbers_that_no_product_can_screen():
    """NaN, infinity and huge values on either side; far from 0 the product alone would be too coarse."""
    (tx, tm), (cx, cm) = rows(40, 4, 0.2, 3), rows(400, 4, 0.2, 4)
    tx[:20] += 1e7
    cx[:200] += 1e7
    for x in (tx, cx):
        x[3, 0], x[4, 1], x[5, 2], x[6, 3] = np.nan, np.inf, -np.inf, 1e200
    args = tx, tm, np.full(40, -1), cx, cm, np.arange(400), 6, 2, True
    with np.errstate(all="ignore"):
        wanted = all_pairs(*args)
    got, _ = searched(*args)
    assert got == wanted


def test_pairs_of_copies_are_bounded():
    """All controls alike: the pairs compared don't grow with their number."""
    x, mask = np.zeros((5000, 3)), np.ones((5000, 3), bool)
    got, pairs = searched(x[:100], mask[:100], np.full(100, -1), x, mask, np.arange(5000), 4, 2, True)
    assert [j for _, j, _, _ in got] == [0, 1, 2, 3] * 100 and pairs.sum() <= 100 * 8 * 2


def profiles(spark, n_treated, n_controls, dims, seed):
    r = np.random.default_rng(seed)
    out = [(1, f"{group[0]}{i}", group, *map(float, r.normal(size=dims)))
           for group, n in (("treated", n_treated), ("control", n_controls)) for i in range(n)]
    return spark.createDataFrame(out, "Ti int, id string, `group` string, " + ", ".join(f"f{i}_z double" for i in range(dims)))


def test_no_table_of_pairs(spark, monkeypatch):
    """Where nothing prunes, the rows written depend on k and the units, not on the cells or the controls that they meet."""
    written = []

    class Counted(PK.Scratch):
        def table(self, df, name, partition_by=None):
            out = super().table(df, name, partition_by)
            written.append(out.count())
            return out

    monkeypatch.setattr(PK, "Scratch", Counted)
    pz = profiles(spark, 150, 600, 10, 5)
    cols = [f"f{i}_z" for i in range(10)]
    t, c = N._split(pz, cols)
    matches, report = PK.nearest_controls(t, c, cols, 4, 2, True, rows_per_salt=40)
    assert matches.count() == 600
    salts, rounds = math.ceil(600 / 200), 2
    assert sum(written) <= 150 * salts * (4 + rounds)
    assert {r.round: r.treated for r in report.collect()} == {1: 150, 2: 150}


@pytest.mark.parametrize("match", [
    lambda pz: N.match_topk(pz, ["f0", "f1"], 3, use_peak_blocking=False, prune=True),
    lambda pz: N.match_topk_allow_missing(pz, ["f0", "f1"], 3, prune=True)])
def test_profiles_are_computed_once(spark, match):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    pz = profiles(spark, 8, 60, 2, 6)
    pz = pz.mapInPandas(counted, pz.schema)
    assert match(pz).count() == 24
    assert seen.value == 68


@pytest.mark.parametrize("rows_per_salt", [7, 20_000])
def test_both_ways_give_the_same_rows(spark, rows_per_salt):
    """With missing features, features that are no number, units in both roles, repeated and missing ids and cohorts."""
    r = np.random.default_rng(7)
    units = [(None if r.random() < 0.02 else int(r.integers(2)), None if r.random() < 0.03 else f"u{r.integers(90)}",
              "treated" if r.random() < 0.3 else "control",
              *[None if r.random() < 0.3 else float("nan") if r.random() < 0.02 else float(r.integers(4)) for _ in range(4)])
             for _ in range(400)]
    pz = spark.createDataFrame(units, "Ti int, id string, `group` string, a_z double, b_z double, c_z double, d_z double")
    f = ["a", "b", "c", "d"]

    def found(df):
        # valid_dim of repeated controls at one distance is in no order
        return sorted(tuple(map(str, x)) for x in df.drop("valid_dim").collect())

    numbers = pz.where(" AND ".join(f"NOT coalesce(isnan({x}_z), false)" for x in f))
    for match in (lambda prune: N.match_topk_allow_missing(pz, f, 4, rows_per_salt=rows_per_salt, prune=prune),
                  lambda prune: N.match_topk(numbers, f, 3, use_peak_blocking=False, rows_per_salt=rows_per_salt, prune=prune)):
        assert found(match(True)) == found(match(False))
