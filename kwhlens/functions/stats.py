"""Distribution tails and safe arithmetic as Spark column expressions.

Neither Spark nor DuckDB ships ``erf``; p-values are therefore computed with
closed-form expressions that stay inside whole-stage codegen:

* standard normal tail: the double-precision rational approximation of
  Hart (1968) as published by West (2005, "Better approximations to
  cumulative normal functions"), absolute error about 1e-14;
* Student-t two-sided tail for integer degrees of freedom: the finite
  trigonometric series of Abramowitz & Stegun 26.7.3 / 26.7.4, evaluated with
  ``aggregate(sequence(...))``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (Hart 1968 / West 2005 cumulative normal, double precision):
# numerator coefficients, highest power first
NORM_NUM = (
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
# denominator coefficients, highest power first
NORM_DEN = (
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
NORM_SWITCH = 7.07106781186547  # rational part below, continued fraction above
NORM_CUTOFF = 37.0  # tail is 0 in double precision beyond this
SQRT_2PI = 2.506628274631

# two-sided 95 % normal quantile, as used for confidence intervals
Z_975 = 1.959963984540054


def _horner(x: Column, coefs) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def normal_upper_tail(x) -> Column:
    """P(Z > x) for a standard normal Z, as a Column (null in → null out)."""
    x = F.col(x) if isinstance(x, str) else x
    ax = F.abs(x)
    expo = F.exp(-ax * ax / 2.0)
    rational = expo * _horner(ax, NORM_NUM) / _horner(ax, NORM_DEN)
    cf = ax + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        cf = ax + F.lit(k) / cf
    contfrac = expo / cf / F.lit(SQRT_2PI)
    lower = (
        F.when(ax > NORM_CUTOFF, F.lit(0.0))
        .when(ax < NORM_SWITCH, rational)
        .otherwise(contfrac)
    )  # = P(Z < -|x|)
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x > 0, lower).otherwise(1.0 - lower)


def normal_two_sided_p(t) -> Column:
    """2 * (1 - Phi(|t|)); null when ``t`` is null."""
    t = F.col(t) if isinstance(t, str) else t
    return 2.0 * normal_upper_tail(F.abs(t))


def t_two_sided_p(t, df) -> Column:
    """Two-sided Student-t p-value for integer degrees of freedom ``df`` >= 1."""
    t = F.col(t) if isinstance(t, str) else t
    nu = F.col(df) if isinstance(df, str) else df
    nu = nu.cast("int")
    theta = F.atan(F.abs(t) / F.sqrt(nu.cast("double")))
    c2 = F.pow(F.cos(theta), 2)
    s = F.sin(theta)
    even = (nu % 2) == 0
    n_terms = F.when(even, (nu - 2) / 2).otherwise((nu - 3) / 2).cast("int")

    def step(acc, j):
        jd = j.cast("double")
        ratio = F.when(even, (2.0 * jd - 1.0) / (2.0 * jd)).otherwise((2.0 * jd) / (2.0 * jd + 1.0))
        term = acc["term"] * ratio * c2
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.when(
        n_terms >= 1,
        F.aggregate(
            F.sequence(F.lit(1), F.greatest(n_terms, F.lit(1))),
            F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
            step,
            lambda acc: acc["total"],
        ),
    ).otherwise(F.lit(1.0))
    a_even = s * series
    a_odd = F.when(nu == 1, 2.0 * theta / math.pi).otherwise(
        (2.0 / math.pi) * (theta + s * F.cos(theta) * series)
    )
    a = F.when(even, a_even).otherwise(a_odd)
    return F.when(t.isNull() | nu.isNull() | (nu < 1), F.lit(None).cast("double")).otherwise(1.0 - a)


def safe_div(num, den) -> Column:
    """num / den, null when den is null or 0 (ANSI-safe)."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    return F.try_divide(num, F.when(den != 0, den))


def null_if_nan(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c, F.lit(None).cast("double"))
