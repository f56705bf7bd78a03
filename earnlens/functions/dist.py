"""Distribution functions for p-values (no scipy in the image).

Applied through Arrow-batched pandas UDFs to one-row statistic tables;
the heavy lifting (sufficient statistics) is a Spark aggregate.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction for the incomplete beta (modified Lentz)."""
    tiny, eps = 1e-300, 3e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            return h
    raise ArithmeticError(f"incomplete beta of ({a}, {b}) at {x} did not converge")


def _log_ratio(a: float, b: float) -> float:
    """log(gamma(a + b) / gamma(a)); by its series where the two logarithms
    would cancel."""
    if a > 1e5 and abs(b) < 1e2:
        return b * math.log(a) + b * (b - 1) / (2 * a) - b * (b - 1) * (2 * b - 1) / (12 * a * a)
    return math.lgamma(a + b) - math.lgamma(a)


def betainc(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta I_x(a, b); ``y`` is 1 - x, given where the
    difference would lose digits."""
    y = 1.0 - x if y is None else y
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    big, little = max(a, b), min(a, b)
    log_x = math.log1p(-y) if y < 0.5 else math.log(x)
    log_y = math.log1p(-x) if x < 0.5 else math.log(y)
    lbt = _log_ratio(big, little) - math.lgamma(little) + a * log_x + b * log_y
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, y) / b


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F > f) for F(d1, d2); the absolute error is about 1e-18 * d2."""
    if f is None or not np.isfinite(f) or d1 <= 0 or d2 <= 0:
        return float("nan")
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))


def t_sf2(t: float, df: float) -> float:
    """Two-sided P(|T| > |t|) for Student t(df)."""
    if t is None or not np.isfinite(t) or df <= 0:
        return float("nan")
    if df > 1e6:  # normal tail and its first correction; what is left out is below 1e-11
        a = abs(t)
        return math.erfc(a / math.sqrt(2)) + math.exp(-a * a / 2) / math.sqrt(2 * math.pi) * (a ** 3 + a) / (2 * df)
    return betainc(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))


def ptukey(q: float, k: int, df: float, n_nodes: int = 160) -> float:
    """CDF of the studentized range Q(k, df) by numerical integration.

    P(Q <= q) = int_0^inf f_s(s) * W(q s) ds, with s the scaled chi
    (sqrt(chi2_df / df)) and W(w) = k int phi(z) [Phi(z) - Phi(z - w)]^(k-1) dz
    the range CDF of k standard normals. Gauss-Legendre on finite ranges."""
    if q <= 0:
        return 0.0
    xs, ws = np.polynomial.legendre.leggauss(n_nodes)

    def w_range(w):
        a, b = -8.0, 8.0
        z = 0.5 * (b - a) * xs + 0.5 * (b + a)
        phi = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
        cdf = 0.5 * np.array([math.erfc(-v / math.sqrt(2)) for v in z])
        cdf_w = 0.5 * np.array([math.erfc(-(v - w) / math.sqrt(2)) for v in z])
        return k * 0.5 * (b - a) * np.sum(ws * phi * np.power(np.clip(cdf - cdf_w, 0, 1), k - 1))

    if not np.isfinite(df) or df > 1e8:  # the scale's spread is below 1e-4, its effect below 1e-8
        return float(w_range(q))
    # density of s = sqrt(X/df), X ~ chi2(df)
    lo, hi = max(1e-6, 1.0 - 12.0 / math.sqrt(df)), 1.0 + 12.0 / math.sqrt(df)
    s = 0.5 * (hi - lo) * xs + 0.5 * (hi + lo)
    logf = (math.log(2.0) + (df / 2.0) * math.log(df / 2.0) - math.lgamma(df / 2.0)
            + (df - 1.0) * np.log(s) - df * s * s / 2.0)
    dens = np.exp(logf)
    vals = np.array([w_range(q * si) for si in s])
    return float(0.5 * (hi - lo) * np.sum(ws * dens * vals))


# ------------------------------------------------------------- Spark wrappers
@F.pandas_udf(DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([f_sf(a, b, c) for a, b, c in zip(f, d1, d2)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_sf2(a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def tukey_pvalue(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([1.0 - ptukey(a, int(b), c) if np.isfinite(a) else float("nan")
                      for a, b, c in zip(q, k, df)], dtype="float64")
