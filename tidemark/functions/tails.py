"""Upper tails of the normal, t and chi-squared distributions, which SQL lacks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            step = c * d
            total *= step
        if abs(step - 1) < 1e-16:
            break
    return front * total


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_tail(df / 2, 0.5, df / (df + t * t))


def chi2_tail(x: float, df: float) -> float:
    """Upper tail of chi-squared: a series below the mean, a continued fraction above."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, tiny = x + 1 - a, 1e-300
    c, d = 1 / tiny, 1 / b
    total = d
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b)
        c = b + num / c
        total *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * total


@F.pandas_udf(DoubleType())
def normal_p(t: pd.Series) -> pd.Series:
    """Two-sided normal p-value."""
    return t.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if pd.notna(v) else np.nan).astype(float)


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_tail(a, b) if pd.notna(a) and pd.notna(b) and b > 0 else np.nan for a, b in zip(t, df, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(a, b) if pd.notna(a) and b > 0 else np.nan for a, b in zip(x, df, strict=True)], dtype=float)
