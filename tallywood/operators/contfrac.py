"""Continued fractions of power series: the numeric kernel that a task runs on one small histogram."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tallywood.functions.special import ln_gamma_np

#: Fold changes at which a fraction must look like a yield curve.
SEARCH = np.cumsum(np.full(2000, 0.05))


def quotient_difference(series: np.ndarray) -> np.ndarray:
    """Coefficients of c0 / (1 + c1 t / (1 + c2 t / ...)) with the series' first terms. Not-a-numbers pass through."""
    p = np.asarray(series, float)
    out = p[:1].tolist()
    with np.errstate(all="ignore"):
        quotients, differences = p[1:] / p[:-1], np.zeros(len(p))
        while len(out) < len(p):
            out.append(-quotients[0])
            if len(out) == len(p):
                break
            differences = quotients[1:] - quotients[:-1] + differences[1 : len(quotients)]
            out.append(-differences[0])
            quotients = quotients[1:-1] * differences[1:] / differences[:-1] if len(differences) > 1 else np.array([np.nan])
    return np.array(out)


@dataclass
class Fraction:
    """A polynomial head of ``offset`` terms and a continued fraction, or the reciprocal of such."""

    fraction: np.ndarray
    head: np.ndarray
    reciprocal: bool = False

    @classmethod
    def of(cls, series: np.ndarray, diagonal: int = 0) -> Fraction:
        """``diagonal`` above 0 keeps so many leading terms as a polynomial; below 0 does so with the reciprocal series."""
        p = np.asarray(series, float)
        if diagonal < 0:
            q = np.zeros(len(p))
            with np.errstate(all="ignore"):
                for k in range(len(p)):
                    q[k] = ((k == 0) - p[1 : k + 1] @ q[:k][::-1]) / p[0]
            p = q
        head = abs(diagonal)
        return cls(quotient_difference(p[head:]), p[:head], diagonal < 0)

    @property
    def degree(self) -> int:
        return len(self.fraction) + len(self.head)

    def truncated(self, degree: int) -> Fraction | None:
        """The fraction of fewer terms, or none where there are not so many."""
        return None if self.degree < degree else Fraction(self.fraction[: degree - len(self.head)], self.head, self.reciprocal)

    def __call__(self, t: np.ndarray) -> np.ndarray:
        t = np.asarray(t, float)
        with np.errstate(all="ignore"):
            below = np.ones_like(t)
            for c in self.fraction[:0:-1]:
                below = 1 + c * t / below
            value = self.fraction[0] / below if len(self.fraction) else np.zeros_like(t)
            for c in self.head[::-1]:
                value = c + t * value
            return 1 / value if self.reciprocal else value


def stable(y: np.ndarray) -> bool:
    """Finite, not negative, not falling and not convex."""
    return bool(len(y) and np.isfinite(y).all() and (y >= 0).all() and (np.diff(y) >= 0).all() and (np.diff(y, 2) <= 0).all())


def optimal(hist: np.ndarray, max_terms: int, diagonal: int = 0) -> Fraction | None:
    """The stable fraction of least degree for the leading bins of a histogram (index: multiplicity), or none."""
    if max_terms < 3 or max_terms >= len(hist):
        return None
    sign = np.where(np.arange(max_terms) % 2 == 0, 1.0, -1.0)
    whole = Fraction.of(sign * hist[1 : max_terms + 1], diagonal)
    for degree in [max_terms] if max_terms <= 6 else range(7 + (max_terms + 1) % 2, max_terms + 1, 2):
        cut = whole.truncated(degree)
        if cut is not None and stable(np.concatenate([[0.0], SEARCH * cut(SEARCH)])):
            return cut
    return None


@dataclass
class Histogram:
    """The bins that a histogram has: multiplicities ``j`` in order and their keys ``h``. Its size is that of the bins, however large a multiplicity."""

    j: np.ndarray
    h: np.ndarray

    @classmethod
    def of(cls, multiplicity, n_keys) -> Histogram:
        j, h = np.asarray(multiplicity, float), np.asarray(n_keys, float)
        order = np.argsort(j)
        order = order[h[order] > 0]
        return cls(j[order], h[order])

    @property
    def total(self) -> float:
        return float(self.j @ self.h)

    @property
    def distinct(self) -> float:
        return float(self.h.sum())

    def head(self, n: int) -> np.ndarray:
        """The keys of multiplicities 0 to ``n``."""
        out, few = np.zeros(n + 1), self.j <= n
        out[self.j[few].astype(int)] = self.h[few]
        return out


def terms_of(hist: np.ndarray, max_terms: int) -> int:
    """Leading bins that a series may use, made even."""
    empty = np.flatnonzero(np.append(hist[1:], 0) <= 0)
    n = min(max_terms, int(empty[0]))
    return n - n % 2


def rarefied(hist: Histogram, sizes: np.ndarray, compat: str = "reference") -> np.ndarray:
    """Expected distinct keys at sample sizes, as :func:`tallywood.operators.rarefy.rarefaction`."""
    total, n = hist.total, np.asarray(sizes, float)[:, None]
    left = total - hist.j
    with np.errstate(all="ignore"):
        ratio = np.exp(ln_gamma_np(left + 1) - ln_gamma_np(left - n + 1) + ln_gamma_np(total - n + 1) - ln_gamma_np(np.array(total + 1)))
    unseen = np.where(left >= n, ratio * hist.h, 0.0)
    return hist.distinct - (np.floor(unseen) if compat == "reference" else unseen).sum(axis=1)


def curve(hist: Histogram, sizes: np.ndarray, max_terms: int, distinct: float | None = None, defects: bool = False, compat: str = "reference") -> np.ndarray | None:
    """Expected distinct keys at growing ``sizes``: rarefaction below the total, a continued fraction from there; none without a stable one.

    ``defects`` takes the fraction of all even terms, stable or not.
    """
    total, head = hist.total, hist.head(max_terms + 1)
    terms = terms_of(head, max_terms)
    if defects:
        sign = np.where(np.arange(terms) % 2 == 0, 1.0, -1.0)
        fraction = Fraction.of(sign * head[1 : terms + 1]) if terms else None
    else:
        fraction = optimal(head, terms)
    if fraction is None:
        return None
    fold = (sizes[sizes >= total] - total) / total
    beyond = (hist.distinct if distinct is None else distinct) + fold * fraction(fold)
    return np.concatenate([rarefied(hist, sizes[sizes < total], compat), beyond])
