"""Two-sided Student-t probabilities, vectorised, without SciPy."""

from __future__ import annotations

from functools import lru_cache
from math import lgamma

import numpy as np

_lgamma = np.vectorize(lgamma, otypes=[float])


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 300) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


def _beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    flip = x > (a + 1.0) / (a + b + 2.0)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        part = np.where(z <= 0.0, 0.0, front * _beta_fraction(p, q, z))
    return np.where(flip, 1.0 - part, part)


def two_sided_p(t: np.ndarray, df: np.ndarray | float) -> np.ndarray:
    """P(|T| >= |t|); an infinite t gives 0, a NaN stays NaN."""
    t = np.asarray(t, dtype=float)
    df = np.broadcast_to(np.asarray(df, dtype=float), t.shape)
    with np.errstate(invalid="ignore"):
        x = df / (df + t * t)
    return np.where(np.isnan(t), np.nan, _beta_inc(df / 2.0, np.full(t.shape, 0.5), np.where(np.isnan(x), 1.0, x)))


@lru_cache(maxsize=64)
def critical(alpha: float, df: float) -> float:
    """The t with ``two_sided_p(t, df) == alpha``, by bisection."""
    low, high = 0.0, 1.0
    while two_sided_p(np.array([high]), df)[0] > alpha:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        low, high = (mid, high) if two_sided_p(np.array([mid]), df)[0] > alpha else (low, mid)
    return (low + high) / 2.0
