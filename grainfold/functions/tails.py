"""Tails of distributions as columns: the regularised incomplete beta function, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relative change of the continued fraction at which it ends.
SETTLED = 1e-15
TINY = 1e-300


def log_gamma(z: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for z > 0, by its asymptotic series from 10 on."""
    z = np.asarray(z, float)
    low = np.zeros_like(z)
    for _ in range(10):  # gamma(z) = gamma(z + 1) / z
        small = z < 10
        low = low - np.where(small, np.log(np.where(small, z, 1.0)), 0.0)
        z = np.where(small, z + 1, z)
    y = 1 / (z * z)
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y * (1 / 1188 - y * (691 / 360360)))))) / z
    return low + (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b) for a, b > 0 and 0 <= x <= 1, by its continued fraction; NaN where an argument is NaN.

    The number of terms grows with the root of the larger of a and b.
    """
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)  # there the other tail converges
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    fraction = _fraction(p, q, y)
    tail = np.where(y <= 0, 0.0, front * fraction)
    out = np.clip(np.where(swap, 1 - tail, tail), 0.0, 1.0)
    return np.where(np.isnan(a + b + x), np.nan, out)


def _fraction(p: np.ndarray, q: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Convergents 1 / (1 + d1 / (1 + d2 / ...)) by ratios of successive numerators and denominators; settled items leave the loop."""
    out = np.full(p.shape, np.nan)
    at = np.flatnonzero(~np.isnan(p + q + y))
    p, q, y = p.ravel()[at], q.ravel()[at], y.ravel()[at]
    above, below = np.ones_like(p), 1 / _not_zero(1 - (p + q) * y / (p + 1))
    value, flat, m = below.copy(), out.reshape(-1), 1
    while len(at):
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        for term in (even, odd):
            below = 1 / _not_zero(1 + term * below)
            above = _not_zero(1 + term / above)
            step = below * above
            value = value * step
        done = np.abs(step - 1) <= SETTLED
        if done.any():
            flat[at[done]] = value[done]
            left = ~done
            at, p, q, y, above, below, value = (v[left] for v in (at, p, q, y, above, below, value))
        m += 1
        if m > 1_000_000:  # numbers that no count of cells reaches
            raise ArithmeticError("the continued fraction does not settle")
    return out


def _not_zero(v: np.ndarray) -> np.ndarray:
    return np.where(np.abs(v) < TINY, TINY, v)


def beta_tail(a: Column, b: Column, x: Column | float) -> Column:
    """I_x(a, b); null where an argument is null."""

    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(incomplete_beta(a.to_numpy(float), b.to_numpy(float), x.to_numpy(float)))

    found = tail(a.cast("double"), b.cast("double"), (x if isinstance(x, Column) else F.lit(float(x))).cast("double"))
    return F.when(~F.isnan(found), found)


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t with df degrees of freedom; null where df is not positive."""
    return F.when(df > 0, beta_tail(df / 2, F.lit(0.5), F.try_divide(df, df + t * t)))
