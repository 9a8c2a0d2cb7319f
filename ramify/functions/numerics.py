"""Numerical kernels on numpy arrays: tail probabilities, robust lines, multiple testing."""

from __future__ import annotations

import math

import numpy as np


def log_beta_tail(a: float, b: float, x: float) -> float:
    """log of the regularised incomplete beta function, by a continued fraction (Lentz)."""
    if x <= 0:
        return -math.inf
    if x >= 1:
        return 0.0
    if x > (a + 1) / (a + b + 2):
        other = log_beta_tail(b, a, 1 - x)
        return math.log1p(-math.exp(other)) if other < -1e-300 else -math.inf
    front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            f *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front + math.log(f / a)


def f_log_sf(x: float, d1: float, d2: float) -> float:
    """log P(F > x)."""
    if not x > 0 or d1 <= 0 or d2 <= 0:
        return 0.0
    return log_beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def f_sf(x: float, d1: float, d2: float) -> float:
    return math.exp(f_log_sf(x, d1, d2))


def t_two_sided(t: float, df: float) -> float:
    return f_sf(t * t, 1, df) if df > 0 else math.nan


def t_quantile(p: float, df: float) -> float:
    """Upper p-quantile: P(T > t) = p, by bisection."""
    lo, hi = 0.0, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) / 2 > p else (lo, mid)
    return (lo + hi) / 2


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_log_sf(x: float, df: float) -> float:
    """log of the upper incomplete gamma ratio Q(df / 2, x / 2)."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 0.0
    front = a * math.log(z) - z - math.lgamma(a)
    if z < a + 1:
        term = total = 1 / a
        k = a
        for _ in range(5000):
            k += 1
            term *= z / k
            total += term
            if term < total * 1e-16:
                break
        low = front + math.log(total)
        return math.log(-math.expm1(low)) if low < 0 else -math.inf
    b = z + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 5000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front + math.log(h)


def chi2_from_log_sf(logp: float, df: float) -> float:
    """x with log P(X > x) = logp, by bisection on a growing bracket."""
    lo, hi = 0.0, max(1.0, df)
    while chi2_log_sf(hi, df) > logp and hi < 1e8:
        lo, hi = hi, hi * 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_log_sf(mid, df) > logp else (lo, mid)
    return (lo + hi) / 2


def bh(p: np.ndarray, log: bool = False) -> np.ndarray:
    """Benjamini-Hochberg without a cap at one; ``log``: natural logs in and out."""
    p = np.asarray(p, float)
    order = np.argsort(p, kind="stable")
    rank = np.arange(1, len(p) + 1)
    q = p[order] + np.log(len(p) / rank) if log else p[order] * len(p) / rank
    out = np.empty(len(p))
    out[order] = np.minimum.accumulate(q[::-1])[::-1]
    return out


def bonferroni(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.asarray(p, float) * len(p), 1.0)


def ols(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope of y on x and its two-sided p value."""
    n, dx = len(x), x - x.mean()
    sxx = float(dx @ dx)
    if n < 3 or sxx == 0:
        return math.nan, math.nan
    slope = float(dx @ (y - y.mean())) / sxx
    resid = y - y.mean() - slope * dx
    se = math.sqrt(float(resid @ resid) / (n - 2) / sxx)
    return slope, (t_two_sided(slope / se, n - 2) if se > 0 else 0.0)


def pearson_matrix(x: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """Correlations of the columns, weighted rows; constant columns give nan."""
    w = np.ones(len(x)) if w is None else w
    c = x - (w @ x) / w.sum()
    cov = (c * w[:, None]).T @ c
    sd = np.sqrt(np.diag(cov))
    with np.errstate(invalid="ignore", divide="ignore"):
        return cov / np.outer(sd, sd)


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties get their mean rank; column-wise."""
    if x.ndim == 2:
        return np.column_stack([average_ranks(c) for c in x.T]) if x.shape[1] else x
    u, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[inverse]
