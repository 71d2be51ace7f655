"""Upper-tail probabilities, computed on Arrow batches holding one row per finished test."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

_TINY = 1e-300
_EPS = 1e-15


def _gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * _EPS:
            n += 1
            term *= x / n
            total += term
        return 1.0 - total * scale
    b = x + 1 - a
    c = 1 / _TINY
    d = 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1) < _EPS:
            return h * scale
    raise ArithmeticError(f"gamma tail of {a}, {x} does not converge")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 100_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + step * d
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = 1 + step / c
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1) < _EPS:
            return h
    raise ArithmeticError(f"beta fraction of {a}, {b}, {x} does not converge")


def _beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def chi2_upper(statistic: float, df: float) -> float:
    """P(X >= statistic) for a chi-squared variable."""
    return _gamma_tail(df / 2, statistic / 2)


def normal_upper(z: float) -> float:
    """P(Z >= z) for a standard normal variable."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t."""
    if math.isinf(t):
        return 0.0
    return _beta_share(df / 2, 0.5, df / (df + t * t))


def _vectorised(function, *series: pd.Series) -> pd.Series:
    rows = zip(*[s.astype(float) for s in series])
    return pd.Series([function(*row) if not np.isnan(row).any() else None for row in rows], dtype="float64")


@F.pandas_udf(DoubleType())
def chi2_p(statistic: pd.Series, df: pd.Series) -> pd.Series:
    return _vectorised(chi2_upper, statistic, df)


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return _vectorised(normal_upper, z)


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _vectorised(t_two_sided, t, df)
