import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kwhlens.functions import stats as S


def t_two_sided_numeric(t, df):
    """Two-sided Student-t tail by numerical integration of the density."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    x = np.linspace(0, abs(t), 200001)
    dens = c * (1 + x * x / df) ** (-(df + 1) / 2)
    return 1.0 - 2.0 * np.trapezoid(dens, x)


def test_normal_tail_matches_erfc(spark):
    xs = [-40.0, -8.0, -3.0, -1.0, 0.0, 0.5, 1.0, 1.96, 3.0, 6.5, 7.2, 10.0, 40.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select("x", S.normal_upper_tail("x").alias("q"), S.normal_two_sided_p("x").alias("p")).collect()
    for r in got:
        ref = 0.5 * math.erfc(r.x / math.sqrt(2))
        assert abs(r.q - ref) <= 1e-14 + 1e-9 * ref
        assert abs(r.p - math.erfc(abs(r.x) / math.sqrt(2))) <= 1e-13


def test_normal_tail_null(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert df.select(S.normal_two_sided_p("x")).first()[0] is None


@pytest.mark.parametrize("df_", [1, 2, 3, 4, 5, 8, 11, 30])
def test_student_t_p(spark, df_):
    ts = [0.0, 0.3, 1.0, 2.2, 4.0]
    frame = spark.createDataFrame([(t, df_) for t in ts], "t double, n int")
    got = frame.select("t", S.t_two_sided_p("t", "n").alias("p")).collect()
    for r in got:
        assert abs(r.p - t_two_sided_numeric(r.t, df_)) < 1e-7


def test_safe_div(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(S.safe_div("a", "b")).collect()] == [None, 0.5, None]


def test_materialize_table_roundtrip(spark):
    from kwhlens.session import checkpoint_dir, materialize

    df = spark.range(100).withColumn("y", F.col("id") * 2)
    out = materialize(df, "table")
    assert out.count() == 100
    assert out.agg(F.sum("y")).first()[0] == 9900
    # written under the session's checkpoint folder, read back as a Parquet scan
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan.lower()
    assert checkpoint_dir(spark)
    with pytest.raises(ValueError):
        materialize(df, "nope")
