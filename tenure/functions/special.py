"""Small numeric helpers for values that Spark has no built-in for."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chi_square_tail(x: float, df: float) -> float:
    """P(X > x) for a chi-square variable, by the regularised incomplete gamma function."""
    if df <= 0 or x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    a, z = df / 2.0, x / 2.0
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1.0:  # series for the lower tail
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= z / n
            total += term
        return max(0.0, 1.0 - total * front)
    # continued fraction for the upper tail (modified Lentz)
    tiny = 1e-300
    b = z + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-16:
            break
    return min(1.0, front * h)


@F.pandas_udf(T.DoubleType())
def chi_square_p(stat: pd.Series, df: pd.Series) -> pd.Series:
    """Tail probability; called on one row per monitored column, never per data row."""
    return pd.Series(
        [
            float("nan") if pd.isna(s) or pd.isna(k) else chi_square_tail(float(s), float(k))
            for s, k in zip(stat, df)
        ]
    )


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float).copy()
    out = np.zeros_like(x)
    while (x < 10).any():
        low = x < 10
        out[low] -= 1.0 / x[low]
        x[low] += 1.0
    y = 1.0 / (x * x)
    tail = y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))
    return out + np.log(x) - 0.5 / x - tail


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float).copy()
    out = np.zeros_like(x)
    while (x < 10).any():
        low = x < 10
        out[low] += 1.0 / (x[low] * x[low])
        x[low] += 1.0
    y = 1.0 / (x * x)
    tail = y * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * 5 / 66))))
    return out + 1.0 / x + 0.5 * y + tail / x


def log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in np.ravel(x)]).reshape(np.shape(x))
