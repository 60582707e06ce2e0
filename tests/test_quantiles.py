"""Exact quantiles by counted bins against NumPy."""

import numpy as np
import pytest

from kwhlens.functions.quantiles import exact_quantiles

QS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("interpolate", [False, True])
def test_equals_numpy(spark, interpolate):
    rng = np.random.default_rng(0)
    groups = {"a": rng.normal(size=2000), "b": np.repeat([1.0, 2.0], [700, 3]), "c": np.array([5.0]),
              "d": rng.integers(0, 4, 500).astype(float)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None)]
    got = {r.g: r for r in exact_quantiles(
        spark.createDataFrame(rows, "g string, x double"), ["g"], "x", QS, interpolate, bins=16).collect()}
    for g, xs in groups.items():
        method = "linear" if interpolate else "inverted_cdf"
        want = np.quantile(xs, QS, method=method)
        assert got[g].n == len(xs)
        assert [got[g][f"q{i}"] for i in range(len(QS))] == pytest.approx(want.tolist())


def test_without_groups_and_empty(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 101)], "x double")
    assert tuple(exact_quantiles(df, [], "x", [0.25, 0.75]).first()) == (100, 25.0, 75.0)
    assert exact_quantiles(df.where("x < 0"), [], "x", [0.5]).count() == 0
