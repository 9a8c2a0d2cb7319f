"""Penalised regression splines of one variable, with their smoothness chosen by GCV.

The basis is the low-rank thin-plate spline: constant, line, and the leading eigenvectors of
the radial functions |d|^3 that are free of them. Smooths that act by group get penalties of
their own. Gaussian response, identity link.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ramify.functions.numerics import f_sf, t_two_sided


@dataclass
class Smooth:
    """Columns for given x, and a penalty matrix; the first columns may be unpenalised."""

    knots: np.ndarray
    turn: np.ndarray
    penalty: np.ndarray
    centre: float
    scale: float

    def columns(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        radial = np.abs(z[:, None] - self.knots[None, :]) ** 3 @ self.turn
        return np.column_stack([z, radial])


def thin_plate(x: np.ndarray, k: int, shrink: bool = False, max_knots: int = 200) -> Smooth:
    """A basis of ``k`` functions with the constant left out (k - 1 columns).

    ``shrink`` also penalises the line a little, so that the whole term can vanish. The radial
    functions stand on the distinct values of x or, beyond ``max_knots`` of them, on as many evenly
    spaced ranks; all rows take part in the fit either way.
    """
    centre, scale = float(x.mean()), float(x.std()) or 1.0
    values = np.unique(x)
    return thin_plate_on(values[spaced(len(values), max_knots)], centre, scale, k, shrink)


def spaced(n: int, most: int = 200) -> np.ndarray:
    """Ranks of the values that get a knot: all of ``n``, or ``most`` evenly spaced ones."""
    return np.arange(n) if n <= most else np.linspace(0, n - 1, most).round().astype(int)


def thin_plate_on(values: np.ndarray, centre: float, scale: float, k: int, shrink: bool = False) -> Smooth:
    """The basis on knots at ``values``, ascending."""
    knots = (values - centre) / scale
    k = max(2, min(k, len(knots)))
    e = np.abs(knots[:, None] - knots[None, :]) ** 3
    value, vector = np.linalg.eigh(e)
    lead = np.argsort(-np.abs(value), kind="stable")[:k]
    value, vector = value[lead], vector[:, lead]
    polynomial = np.column_stack([np.ones(len(knots)), knots])
    # Coefficients must be orthogonal to constant and line.
    q, _ = np.linalg.qr(vector.T @ polynomial, mode="complete")
    free = q[:, 2:]
    s = free.T @ np.diag(value) @ free
    s = (s + s.T) / 2
    turn = vector @ free
    if s.size and np.trace(s) < 0:
        turn, s = -turn, s
    w, v = np.linalg.eigh(s) if s.size else (np.zeros(0), np.zeros((0, 0)))
    w = np.abs(w)
    penalty = np.zeros((1 + len(w), 1 + len(w)))
    penalty[1:, 1:] = v @ np.diag(w) @ v.T if len(w) else 0
    if shrink:
        penalty[0, 0] = 0.1 * (w[w > 0].min() if (w > 0).any() else 1.0)
    return Smooth(knots, turn, penalty, centre, scale)


@dataclass
class Fit:
    fitted: np.ndarray
    edf: float
    deviance: float
    beta: np.ndarray
    se: np.ndarray
    cov: np.ndarray
    design: np.ndarray
    df_residual: float

    def p_value(self, column: int) -> float:
        """Two-sided t test of a parametric coefficient."""
        if self.se[column] == 0 or self.df_residual <= 0:
            return 1.0
        return t_two_sided(self.beta[column] / self.se[column], self.df_residual)

    def band(self) -> np.ndarray:
        return np.sqrt(np.maximum(0, np.einsum("ij,jk,ik->i", self.design, self.cov, self.design)))


@dataclass
class SumFit:
    """A fit known by sums over its rows only."""

    edf: float
    deviance: float
    beta: np.ndarray
    cov: np.ndarray
    df_residual: float

    def p_value(self, column: int) -> float:
        """Two-sided t test of a parametric coefficient."""
        se = np.sqrt(max(0.0, self.cov[column, column]))
        return t_two_sided(self.beta[column] / se, self.df_residual) if se > 0 and self.df_residual > 0 else 1.0


def fit_sums(xx: np.ndarray, xy: np.ndarray, yy: float, n: int, terms: list[tuple[int, int, np.ndarray]], gamma: float = 1.0) -> SumFit:
    """Least squares with one smoothing parameter per term (first column, end, penalty), by coordinate search on GCV.

    ``xx``, ``xy`` and ``yy`` are the sums of products of the design's columns and the response over ``n`` rows.
    """
    p = len(xx)
    full = []
    for a, b, s in terms:
        big = np.zeros((p, p))
        big[a:b, a:b] = s / (np.abs(s).max() or 1.0) * max(1e-12, float(np.diag(xx)[a:b].max()))
        full.append(big)
    jitter = np.eye(p) * 1e-10 * max(1.0, np.trace(xx) / p)

    def solve(logs: list[float]) -> tuple[float, np.ndarray, float, float, np.ndarray]:
        inner = xx + sum((10.0**v * s for v, s in zip(logs, full, strict=True)), np.zeros((p, p))) + jitter
        inv = np.linalg.inv(inner)
        beta = inv @ xy
        edf = float(np.trace(inv @ xx))
        rss = max(1e-14 * yy, yy - 2 * float(beta @ xy) + float(beta @ xx @ beta))  # less is rounding
        left = n - gamma * edf
        gcv = n * rss / left**2 if left > 0 else np.inf
        return gcv, beta, edf, rss, inv

    logs = [-2.0] * len(terms)
    for width in (8, 3, 1, 0.4, 0.15):
        for i in range(len(terms)):
            options = [np.clip(logs[i] + width * d, -10, 8) for d in (-1, -0.5, 0, 0.5, 1)]
            logs[i] = min(options, key=lambda v: solve([*logs[:i], v, *logs[i + 1 :]])[0])
    _, beta, edf, rss, inv = solve(logs)
    left = n - edf
    return SumFit(edf, rss, beta, inv * (rss / left if left > 0 else 0.0), left)


def penalised(y: np.ndarray, parametric: np.ndarray, terms: list[tuple[np.ndarray, np.ndarray]], gamma: float = 1.0) -> Fit:
    """fit_sums with the design at hand: parametric columns, then a block of columns and a penalty for each term."""
    blocks = [parametric, *[x for x, _ in terms]]
    design = np.hstack(blocks)
    q_, r_ = np.linalg.qr(design)
    spots = np.cumsum([0, *[b.shape[1] for b in blocks]])
    places = [(int(a), int(b), s) for a, b, (_, s) in zip(spots[1:], spots[2:], terms, strict=False)]
    f = fit_sums(r_.T @ r_, r_.T @ (q_.T @ y), float(y @ y), len(y), places, gamma)
    fitted = design @ f.beta
    deviance = float(((y - fitted) ** 2).sum())
    cov = f.cov * (deviance / f.deviance) if f.deviance > 0 else f.cov * 0
    return Fit(fitted, f.edf, deviance, f.beta, np.sqrt(np.maximum(0, np.diag(cov))), cov, design, f.df_residual)


def group_terms(sums: list[tuple[int, np.ndarray]], penalty: np.ndarray | None, shared: bool = True, by: bool = True) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """(turn, terms) of y ~ [s(t)] + [s(t, by = group)] + group, from each group's rows and sums of products of (1, columns of s).

    ``turn`` takes these raw columns of all groups, side by side, to those of the design.
    """
    g, k = len(sums), len(sums[0][1])
    n = sum(m for m, _ in sums)
    mean = sum(xx[0] for _, xx in sums) / n
    one = np.zeros((g * k, g))
    one[np.arange(g) * k, np.arange(g)] = 1
    parts, terms = [one.sum(axis=1, keepdims=True), one[:, 1:]], []
    if penalty is not None and k > 1:
        own = []
        for c in range(g):
            x = np.zeros((g * k, k - 1))
            x[c * k + 1 : (c + 1) * k] = np.eye(k - 1)
            x[c * k] = -mean[1:]
            own.append(x)
        for x in ([sum(own)] if shared else []) + (own if by else []):
            at = sum(p.shape[1] for p in parts)
            terms.append((at, at + k - 1, penalty))
            parts.append(x)
    return np.hstack(parts), terms


def gam(t: np.ndarray, y: np.ndarray, k: int = 5, gamma: float = 1.0, shrink: bool = False) -> Fit:
    """y ~ s(t, k)."""
    one = np.ones((len(t), 1))
    if len(np.unique(t)) < 3:
        return penalised(y, one, [], gamma)
    smooth = thin_plate(t, k, shrink)
    columns = smooth.columns(t)
    return penalised(y, one, [(columns - columns.mean(axis=0), smooth.penalty)], gamma)


def group_gam(t: np.ndarray, y: np.ndarray, group: np.ndarray, k: int = 5, shared: bool = True, by: bool = True, levels: bool = True) -> Fit:
    """y ~ [s(t)] + [s(t, by = group)] + [group]; group codes count from 0."""
    codes = np.arange(1, int(group.max(initial=0)) + 1)
    parametric = np.column_stack([np.ones(len(t)), *[(group == c).astype(float) for c in codes if levels]])
    terms = []
    if len(np.unique(t)) >= 3:
        smooth = thin_plate(t, k)
        columns = smooth.columns(t)
        columns = columns - columns.mean(axis=0)
        if shared:
            terms.append((columns, smooth.penalty))
        for c in range(len(codes) + 1) if by else ():
            terms.append((columns * (group == c)[:, None], smooth.penalty))
    return penalised(y, parametric, terms)


def anova_p(full: Fit | SumFit, small: Fit | SumFit) -> float:
    """F test of nested fits; 1 where the larger one gains nothing."""
    df = full.edf - small.edf
    if df <= 1e-6 or full.df_residual <= 0 or full.deviance <= 0:
        return 1.0
    return f_sf((small.deviance - full.deviance) / df / (full.deviance / full.df_residual), df, full.df_residual)
