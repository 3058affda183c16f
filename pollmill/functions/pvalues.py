"""Tail probabilities for small result tables (one row per test, never per respondent)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F, types as T

Z_975 = 1.959963984540054


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_tail(x: float, df: float) -> float:
    """P(X > x) for a chi-square variable: the regularised upper incomplete gamma function."""
    if not (df > 0) or math.isnan(x):
        return math.nan
    if x <= 0:
        return 1.0
    a, h = df / 2.0, x / 2.0
    scale = math.exp(-h + a * math.log(h) - math.lgamma(a))
    if h < a + 1.0:  # power series of the lower function
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= h / k
            total += term
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300  # continued fraction of the upper function
    b = h + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    frac = d
    for i in range(1, 10000):
        coef = -i * (i - a)
        b += 2.0
        d = 1.0 / (coef * d + b or tiny)
        c = b + coef / c or tiny
        step = d * c
        frac *= step
        if abs(step - 1.0) < 1e-15:
            break
    return min(1.0, scale * frac)


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p-value of a z statistic."""
    return z.map(lambda v: None if pd.isna(v) else normal_two_sided(v))


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of a chi-square statistic."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) else chi2_tail(float(a), float(b)) for a, b in zip(x, df)], dtype="float64")
