"""Gauss quadrature of a moment sequence: the numeric kernel of the lower bound on the number of classes."""

from __future__ import annotations

import numpy as np

from tallywood.functions.special import ln_gamma_np


def moments_of(hist: np.ndarray, many: int) -> np.ndarray:
    """(r + 1)! h[r + 1] / h[1] for r below ``many``; up to the first empty bin or overflow."""
    out = []
    for r in range(min(many, len(hist) - 1)):
        with np.errstate(all="ignore"):
            m = np.exp(ln_gamma_np(np.array(r + 2.0)) + np.log(hist[r + 1]) - np.log(hist[1])) if hist[r + 1] > 0 else 0.0
        if not np.isfinite(m) or m <= 0:
            break
        out.append(float(m))
    return np.array(out)


def determinants(moments: np.ndarray, points: int) -> tuple[float, float]:
    """Of the Hankel matrix of so many rows and of the shifted one."""
    at = np.add.outer(np.arange(points), np.arange(points))
    return float(np.linalg.det(moments[at])), float(np.linalg.det(moments[at + 1]))


def definite(moments: np.ndarray, most_points: int, tolerance: float = 1e-20) -> int:
    """Points that the sequence supports: as long as its Hankel matrix and the shifted one have positive determinants."""
    points = 1
    while points < most_points and 2 * (points + 1) <= len(moments) and min(determinants(moments, points + 1)) > tolerance:
        points += 1
    return points


def recurrence(moments: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """The three-term recurrence (alpha, beta) of the orthogonal polynomials, by Chebyshev's algorithm."""
    before, now = np.zeros(2 * points), moments[: 2 * points].astype(float)
    alpha, beta = [now[1] / now[0]], [now[0]]
    for k in range(1, points):
        after = np.zeros(2 * points)
        for i in range(k, 2 * points - k):
            after[i] = now[i + 1] - alpha[-1] * now[i] - beta[-1] * before[i]
        a, b = after[k + 1] / after[k] - now[k] / now[k - 1], after[k] / now[k - 1]
        if not (np.isfinite(a) and np.isfinite(b)) or a <= 0 or b <= 0:
            break
        alpha.append(a)
        beta.append(b)
        before, now = now, after
    return np.array(alpha), np.array(beta)


def rule(moments: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights (of sum 1) by the eigenvalues of the Jacobi matrix; empty where a node is not positive."""
    alpha, beta = recurrence(moments, points)
    off = np.sqrt(beta[1:])
    nodes, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(off, 1) + np.diag(off, -1))
    if not (np.isfinite(nodes) & (nodes > 0)).all():
        return np.empty(0), np.empty(0)
    weights = vectors[0] ** 2
    return nodes, weights / weights.sum()


def richness(hist: np.ndarray, most_points: int = 10, singletons: float | None = None, distinct: float | None = None) -> tuple[float, int]:
    """The quadrature estimate of all classes, and its points; the observed ones and 0 where there is none."""
    seen = float(hist.sum()) if distinct is None else distinct
    if len(hist) < 2 or hist[1] <= 0:
        return seen, 0
    moments = moments_of(hist, 2 * most_points)
    if len(moments) < 2:
        return seen, 0
    nodes, weights = rule(moments, definite(moments, most_points))
    unseen = float(((hist[1] if singletons is None else singletons) * weights / nodes).sum())
    return (unseen + seen, len(nodes)) if unseen > 0 else (seen, 0)
