"""Tail probabilities of test statistics, vectorised, without further libraries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

_erfc = np.vectorize(math.erfc, otypes=[float])


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(z) / math.sqrt(2))


def chi2_upper(x: float, dof: int) -> float:
    """Upper tail of chi squared, by the recurrence in the degrees of freedom."""
    if x <= 0:
        return 1.0
    if dof % 2:
        out, term, k = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2), 3
    else:
        out, term, k = math.exp(-x / 2), math.exp(-x / 2) * x / 2, 4
    while k <= dof:
        out += term
        term *= x / k
        k += 2
    return min(1.0, out)


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_incomplete(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    return beta_incomplete(dof / 2, 0.5, dof / (dof + t * t)) if dof > 0 else float("nan")


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series(np.where(z.isna(), np.nan, normal_two_sided(z.fillna(0).to_numpy()))).where(z.notna().to_numpy())


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_upper(a, int(b)) if a == a and b >= 1 else None for a, b in zip(x, dof)], dtype=float)


@F.pandas_udf(DoubleType())
def spearman_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    out = []
    for r, k in zip(rho, n):
        if r != r or k < 3:
            out.append(None)
        elif abs(r) >= 1:
            out.append(0.0)
        else:
            out.append(t_two_sided(r * math.sqrt((k - 2) / (1 - r * r)), k - 2))
    return pd.Series(out, dtype=float)


def bonferroni(p: Column, tests: int | Column) -> Column:
    return F.least(p * tests, F.lit(1.0))
