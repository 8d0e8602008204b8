"""Distribution functions for small report tables, as vectorised pandas UDFs (no such built-ins exist)."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

TINY, TERMS, CLOSE = 1e-300, 2000, 1e-14


def _lgamma(x):
    # made anew each time: a vectorised function that has run once cannot be shipped to executors
    return np.vectorize(math.lgamma, otypes=[float])(x)


def _erfc(x):
    return np.vectorize(math.erfc, otypes=[float])(x)


def _gamma_lower(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    x = np.maximum(x, 0.0)
    front = np.exp(-x + a * np.log(np.maximum(x, TINY)) - _lgamma(a))
    term = 1.0 / a
    total = term.copy()
    for k in range(1, TERMS):
        term = term * x / (a + k)
        total = total + term
        if np.all(term <= total * CLOSE):
            break
    low = front * total
    b = x + 1 - a
    c = np.full_like(x, 1 / TINY)
    d = 1 / np.where(b == 0, TINY, b)
    h = d
    for k in range(1, TERMS):
        an = -k * (k - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < TINY, TINY, d)
        c = b + an / c
        c = np.where(np.abs(c) < TINY, TINY, c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < CLOSE):
            break
    return np.where(x == 0, 0.0, np.where(x < a + 1, low, 1 - front * h))


def _beta_inc(a, b, x):
    """Regularised incomplete beta by its continued fraction, using symmetry for the larger tail."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    x = np.clip(x, 0.0, 1.0)
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(np.maximum(y, TINY))
                   + q * np.log(np.maximum(1 - y, TINY))) / p
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < TINY, TINY, d)
    h = d
    for m in range(1, TERMS):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
                    -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < TINY, TINY, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < TINY, TINY, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < CLOSE):
            break
    v = front * h
    v = np.where(y <= 0, 0.0, np.where(y >= 1, 1.0, v))
    return np.where(flip, 1 - v, v)


def normal_p(x, mean, sd):
    z = (np.asarray(x, float) - mean) / sd
    return 0.5 * _erfc(-z / math.sqrt(2))


def poisson_p(k, mean):
    return 1 - _gamma_lower(np.floor(np.asarray(k, float)) + 1, mean)


def binomial_p(k, n, p):
    k, n = np.asarray(k, float), np.asarray(n, float)
    return np.where(k >= n, 1.0, _beta_inc(np.maximum(n - k, 1e-9), k + 1, 1 - np.asarray(p, float)))


@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series, mean: pd.Series, sd: pd.Series) -> pd.Series:
    return pd.Series(normal_p(x, mean, sd))


@F.pandas_udf(T.DoubleType())
def poisson_cdf(k: pd.Series, mean: pd.Series) -> pd.Series:
    return pd.Series(poisson_p(k, mean))


@F.pandas_udf(T.DoubleType())
def binomial_cdf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(binomial_p(k, n, p))


@F.pandas_udf(T.DoubleType())
def chi2_cdf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(_gamma_lower(np.asarray(df, float) / 2, np.asarray(x, float) / 2))


@F.pandas_udf(T.DoubleType())
def beta_cdf(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_beta_inc(a, b, x))
