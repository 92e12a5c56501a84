"""Two-sided p-value of a correlation, for the few rows an aggregation leaves."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

NORMAL_FROM = 1_000_000  # degrees of freedom beyond which t is normal to six digits


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 5000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return total


def regularised_beta(x: float, a: float, b: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(x, a, b) / a
    return 1.0 - front * _beta_fraction(1.0 - x, b, a) / b


def two_sided_p(r: float, n: float) -> float:
    """P(|T| > t) for t = r·sqrt((n−2)/(1−r²)) with n−2 degrees of freedom."""
    if r is None or n is None or math.isnan(r) or n < 3:
        return float("nan")
    free, rest = n - 2, max(1.0 - r * r, 0.0)
    if rest == 0.0:
        return 0.0
    if free > NORMAL_FROM:
        return math.erfc(abs(r) * math.sqrt(free / rest) / math.sqrt(2.0))
    return regularised_beta(rest, free / 2.0, 0.5)


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    found = pd.Series([two_sided_p(a, b) for a, b in zip(r, n)], dtype="float64")
    return found.replace({np.nan: None}) if found.isna().any() else found
