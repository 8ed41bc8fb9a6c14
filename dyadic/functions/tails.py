"""Tail probabilities, written with numpy only, and their Arrow UDF forms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _lgamma(x: np.ndarray) -> np.ndarray:
    values, where = np.unique(x, return_inverse=True)
    return np.array([math.lgamma(v) for v in values])[where].reshape(np.shape(x))


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the beta function; log-gammas of large arguments are subtracted by their series, not as numbers."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    far = high > 100.0

    def rest(x: np.ndarray) -> np.ndarray:
        return (1 / 12 - (1 / 360 - 1 / (1260 * x * x)) / (x * x)) / x

    big = np.where(far, high, 200.0)
    gap = (big - 0.5) * np.log1p(low / big) + low * np.log(big + low) - low + rest(big + low) - rest(big)
    near = np.where(far, 1.0, high)
    return _lgamma(low) - np.where(far, gap, _lgamma(near + low) - _lgamma(near))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function in its contracted form (Didonato and Morris), y = 1 - x.

    An entry is done when its own value stands still; entries that go on do not move it.
    """
    slope = np.where(x < y, 1.0 + a - (a + b) * x, 1.0 + (a + b) * y - b)
    s, p = a + 1.0, np.ones_like(a)
    above, below = [np.zeros_like(a), np.ones_like(a)], [np.ones_like(a), slope / (1.0 + 1.0 / a)]
    out, live = below[0] / below[1], np.arange(len(a))
    for n in range(1, 20_000):
        share = n / a
        w = n * (b - n) * x
        alpha = p * (p + b / a) * (a / s) ** 2 * w * x
        beta = n + w / s + (1.0 + share) / (1.0 + 1.0 / a + 2.0 * share) * (slope + n * (1.0 + y))
        p, s = 1.0 + share, s + 2.0
        above = [above[1], alpha * above[0] + beta * above[1]]
        below = [below[1], alpha * below[0] + beta * below[1]]
        above = [v / below[1] for v in above]
        below = [below[0] / below[1], np.ones_like(a)]
        moving = np.abs(above[1] - out[live]) > 1e-15 * np.abs(above[1])
        out[live] = above[1]
        if not moving.any():
            return out
        a, b, x, y, s, p, slope, live = (v[moving] for v in (a, b, x, y, s, p, slope, live))
        above, below = [v[moving] for v in above], [v[moving] for v in below]
    raise ArithmeticError("the incomplete beta function did not converge")


def beta_cdf(a, b, x, rest=None) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b); `rest` is 1 - x where the caller knows it more exactly."""
    a, b, x, y = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x, 1.0 - x if rest is None else rest)))
    inside = (x > 0) & (y > 0)
    out = np.where(y <= 0, 1.0, 0.0)
    if inside.any():
        ai, bi, xi, yi = a[inside], b[inside], x[inside], y[inside]
        # The logarithm of the larger of x and y is taken from the smaller one.
        log_x = np.where(yi < 0.5, np.log1p(-np.minimum(yi, 0.5)), np.log(xi))
        log_y = np.where(xi < 0.5, np.log1p(-np.minimum(xi, 0.5)), np.log(yi))
        front = np.exp(ai * log_x + bi * log_y - _log_beta(ai, bi))
        swap = xi > (ai + 1.0) / (ai + bi + 2.0)
        p, q, u, v = np.where(swap, bi, ai), np.where(swap, ai, bi), np.where(swap, yi, xi), np.where(swap, xi, yi)
        part = front * _beta_fraction(p, q, u, v)
        out[inside] = np.where(swap, 1.0 - part, part)
    return out


def t_two_sided(t, df) -> np.ndarray:
    """P(|T| >= |t|) with `df` degrees of freedom; NaN where df <= 0 or t is NaN."""
    t, df = np.broadcast_arrays(np.asarray(t, dtype=float), np.asarray(df, dtype=float))
    ok = np.isfinite(df) & (df > 0) & ~np.isnan(t)
    out = np.full(t.shape, np.nan)
    with np.errstate(over="ignore", divide="ignore"):
        square = t[ok] ** 2
        out[ok] = beta_cdf(df[ok] / 2.0, 0.5, df[ok] / (df[ok] + square), 1.0 / (1.0 + df[ok] / square))
    return out


def f_upper(f, d1, d2) -> np.ndarray:
    """P(F >= f) with (d1, d2) degrees of freedom."""
    f, d1, d2 = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (f, d1, d2)))
    ok = (d1 > 0) & (d2 > 0) & ~np.isnan(f)
    out = np.full(f.shape, np.nan)
    with np.errstate(over="ignore", divide="ignore"):
        up = d1[ok] * np.maximum(f[ok], 0.0)
        out[ok] = beta_cdf(d2[ok] / 2.0, d1[ok] / 2.0, d2[ok] / (d2[ok] + up), 1.0 / (1.0 + d2[ok] / up))
    return out


def boundary_lrt(stat) -> np.ndarray:
    """Mixture p-value for a variance on its boundary: 1 at or below zero, else half the chi-square(1) tail."""
    stat = np.asarray(stat, dtype=float)
    tail = np.array([0.5 * math.erfc(math.sqrt(max(s, 0.0) / 2.0)) if s == s else math.nan for s in stat.ravel()])
    return np.where(stat <= 0, 1.0, tail.reshape(stat.shape))


def hypergeom_upper(k: int, total: int, marked: int, drawn: int) -> float:
    """P(X >= k) when `drawn` items leave a population of `total` holding `marked`."""
    low, high = max(0, drawn - (total - marked)), min(marked, drawn)
    if k <= low:
        return 1.0
    if k > high:
        return 0.0

    def log_choose(n: int, r: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)

    x = np.arange(k, high)
    first = log_choose(marked, k) + log_choose(total - marked, drawn - k) - log_choose(total, drawn)
    steps = np.log((marked - x) * (drawn - x)) - np.log((x + 1.0) * (total - marked - drawn + x + 1.0))
    logs = first + np.concatenate([[0.0], np.cumsum(steps)])
    peak = logs.max()
    return float(min(1.0, math.exp(peak) * np.exp(logs - peak).sum()))


@F.pandas_udf(DoubleType())
def t_two_sided_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(dtype=float, na_value=np.nan), df.to_numpy(dtype=float, na_value=np.nan)))


@F.pandas_udf(DoubleType())
def f_upper_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_upper(f.to_numpy(float, na_value=np.nan), d1.to_numpy(float), d2.to_numpy(float)))


@F.pandas_udf(DoubleType())
def boundary_lrt_udf(stat: pd.Series) -> pd.Series:
    return pd.Series(boundary_lrt(stat.to_numpy(dtype=float, na_value=np.nan)))


@F.pandas_udf(DoubleType())
def hypergeom_upper_udf(k: pd.Series, total: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
    return pd.Series(
        [hypergeom_upper(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(k, total, marked, drawn)], dtype=float
    )


def clean_nan(col):
    """NaN to NULL, as the long tables hold missing values."""
    return F.when(F.isnan(col), F.lit(None).cast("double")).otherwise(col)


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of the log-gamma function for positive arguments: recurrence up to 10, then its asymptotic series."""
    x = np.array(x, dtype=float)
    out = np.zeros_like(x)
    while (small := x < 10).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    inverse = 1 / (x * x)
    series = inverse * (1 / 12 - inverse * (1 / 120 - inverse * (1 / 252 - inverse * (1 / 240 - inverse / 132))))
    return out + np.log(x) - 0.5 / x - series
