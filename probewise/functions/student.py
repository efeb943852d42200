"""Two-sided p-value of Student's t, for the one aggregated row of a correlation."""

from __future__ import annotations

from math import exp, lgamma, log

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _incomplete_beta(b, a, 1.0 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1.0 - x)) / a
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), 1e-300)
    value = d
    # the fraction settles within some multiple of sqrt(a) terms
    for m in range(1, 1000 + int(20 * max(a, b) ** 0.5)):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / (1.0 + step * d)
            c = 1.0 + step / c
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return front * value
    raise ArithmeticError(f"no convergence for a={a}, b={b}, x={x}")


def two_sided(t: float, df: float) -> float:
    return _incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def p_value(t: Column, df: Column) -> Column:
    """Null for a null t or no degrees of freedom; an infinite t has p 0."""
    @F.pandas_udf("double")
    def both(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([two_sided(a, b) if a == a and b > 0 else None for a, b in zip(ts, dfs)], dtype="float64")

    return both(t.cast("double"), df.cast("double"))
