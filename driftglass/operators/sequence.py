"""Smoothers of ordered sequences: Whittaker-Eilers and total variation.

Rows are ordered by their one predictor (ties by row), spacing does not count. Each curve is one group of rows; many
curves are fitted at once with `plans.grouped.fit_groups`.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from math import comb

import numpy as np


def difference_row(order: int) -> np.ndarray:
    """Coefficients of the difference of that order: (-1)^(order - j) C(order, j)."""
    return np.array([(-1) ** (order - j) * comb(order, j) for j in range(order + 1)], float)


def penalty_bands(n: int, order: int) -> np.ndarray:
    """The bands of D'D: row b holds the entries (i, i + b), half-width `order`."""
    c, bands = difference_row(order), np.zeros((order + 1, n))
    for b in range(order + 1):
        for j in range(order + 1 - b):
            bands[b, j:j + n - order] += c[j] * c[j + b]
    return bands


def banded_factor(bands: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(L, d) with A = L diag(d) L', L unit lower with L[b, i] its entry (i + b, i); None unless positive definite."""
    half, n = bands.shape[0] - 1, bands.shape[1]
    low, d = np.zeros((half + 1, n)), np.zeros(n)
    a = bands.copy()
    for i in range(n):
        d[i] = a[0, i]
        if not d[i] > 1e-12:
            return None
        reach = min(half, n - 1 - i)
        low[1:reach + 1, i] = a[1:reach + 1, i] / d[i]
        for b in range(1, reach + 1):
            a[:reach + 1 - b, i + b] -= low[b, i] * a[b:reach + 1, i]
    low[0] = 1
    return low, d


def banded_solve(low: np.ndarray, d: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solve with a factor; right may have several columns."""
    half, n = low.shape[0] - 1, low.shape[1]
    x = np.array(right, float)
    for i in range(n):
        for b in range(1, min(half, n - 1 - i) + 1):
            x[i + b] -= low[b, i] * x[i]
    x = (x.T / d).T
    for i in range(n - 1, -1, -1):
        for b in range(1, min(half, n - 1 - i) + 1):
            x[i] -= low[b, i] * x[i + b]
    return x


def banded_inverse_diagonal(low: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Diagonal of the inverse by the backward recursion within the band."""
    half, n = low.shape[0] - 1, low.shape[1]
    s = np.zeros((half + 1, n))  # s[b, i] = inverse entry (i, i + b)
    for i in range(n - 1, -1, -1):
        reach = min(half, n - 1 - i)
        for b in range(reach, 0, -1):
            s[b, i] = -sum(low[c, i] * s[abs(b - c), i + min(b, c)] for c in range(1, reach + 1))
        s[0, i] = 1 / d[i] - sum(low[c, i] * s[c, i] for c in range(1, reach + 1))
    return s[0]


def banded_square(bands: np.ndarray) -> np.ndarray:
    """The bands of A A for a symmetric A."""
    half, n = bands.shape[0] - 1, bands.shape[1]
    out = np.zeros((2 * half + 1, n))
    for b in range(2 * half + 1):
        for c in range(max(-half, b - half), min(half, b + half) + 1):  # A[i, i + c] A[i + c, i + b]
            i = np.arange(max(0, -c), n - max(b, c, 0))
            out[b, i] += bands[abs(c), np.minimum(i, i + c)] * bands[abs(b - c), np.minimum(i + c, i + b)]
    return out


#: Largest penalty * 4**order for which squaring the system loses no more than about six of sixteen digits.
SQUARED = 1e5


#: Curves of one length share their system, which a worker keeps, up to this length; their rows are solved for to full precision.
KEPT_LENGTH = 2048


def whittaker_system(n: int, penalty: float, order: int, errors: bool, exact: int = KEPT_LENGTH) -> tuple | None:
    """(factor, trace of the inverse, lengths of the inverse's rows or None) of 1 + penalty D'D over n places.

    Beyond `exact` places, row lengths are roots of the diagonal of the squared system's inverse, which is banded too, so they take time in
    proportion to n; up to there, or where squaring would lose too many digits, rows are solved for in blocks.
    """
    bands = penalty * penalty_bands(n, order)
    bands[0] += 1
    factor = banded_factor(bands)
    if factor is None:
        return None
    lengths = None
    if errors and n > exact and penalty * 4.0**order <= SQUARED:
        squared = banded_factor(banded_square(bands))
        lengths = None if squared is None else np.sqrt(np.maximum(banded_inverse_diagonal(*squared), 0))
    if errors and lengths is None:
        lengths = np.empty(n)
        for s in range(0, n, 512):
            right = np.zeros((n, min(512, n - s)))
            right[np.arange(s, s + right.shape[1]), np.arange(right.shape[1])] = 1
            lengths[s:s + right.shape[1]] = np.sqrt((banded_solve(*factor, right) ** 2).sum(axis=0))
    return factor, float(banded_inverse_diagonal(*factor).sum()), lengths


_kept_system = lru_cache(maxsize=512)(whittaker_system)


@dataclass
class Sequence:
    """What the two smoothers share: the ordered sequence and numbers at its places."""

    x: np.ndarray
    y: np.ndarray
    penalty: float
    row_ids: np.ndarray
    order: np.ndarray
    fitted: np.ndarray = field(default=None)
    errors: np.ndarray = field(default=None)
    sigma: float = 0.0
    trace: float = 0.0
    family = "gaussian"

    @staticmethod
    def prepare(x, y):
        x, y = np.asarray(x, float), np.asarray(y, float)
        x = x[:, None] if x.ndim == 1 else x
        if x.ndim != 2 or x.shape[1] != 1 or len(x) != len(y) or not len(y) or not np.isfinite(x).all() or not np.isfinite(y).all():
            return None
        return x, y, np.argsort(x[:, 0], kind="stable")

    def _finish(self, ordered: np.ndarray, trace: float):
        self.fitted = np.empty(len(ordered))
        self.fitted[self.order] = ordered
        self.trace = float(trace)
        self.sigma = float(np.sqrt(((self.y - self.fitted) ** 2).sum() / max(len(ordered) - trace, 1)))

    def gcv(self) -> float:
        n = len(self.y)
        return float(((self.y - self.fitted) ** 2).sum() / n / max(1 - self.trace / n, 1e-6) ** 2)

    @property
    def sorted_x(self):
        return self.x[self.order, 0]

    def _at(self, queries, values, policy):
        raise NotImplementedError

    def predict(self, queries, policy="polynomial", fast=False):
        return self._at(np.asarray(queries, float).reshape(-1), self.fitted[self.order], policy)

    def standard_error(self, queries, policy="polynomial", fast=False):
        return self._at(np.asarray(queries, float).reshape(-1), self.errors[self.order], policy)

    def _outside(self, q, values, policy, inside):
        """Outside the sequence there is no value, but for the ends under the nearest policy."""
        x = self.sorted_x
        out = np.where((q >= x[0]) & (q <= x[-1]), inside, np.nan)
        if policy == "nearest":
            out = np.where(q < x[0], values[0], np.where(q > x[-1], values[-1], out))
        return out


@dataclass
class Whittaker(Sequence):
    """The sequence z with the smallest |y - z|^2 + penalty |D z|^2, D a difference of order 1 to 3."""

    degree: int = 2

    @classmethod
    def fit(cls, x, y, penalty=100.0, order=2, row_ids=None, errors=True):
        ready = cls.prepare(x, y)
        if ready is None or order not in (1, 2, 3) or not (np.isfinite(penalty) and penalty >= 0) or len(y) <= order:
            return None
        x, y, places = ready
        model = cls(x, y, penalty, np.arange(len(y)) if row_ids is None else np.asarray(row_ids), places, degree=order)
        n = len(y)
        if penalty == 0:
            model._finish(y[places], n)
            model.errors = np.full(n, model.sigma)
            return model
        system = (_kept_system if n <= KEPT_LENGTH else whittaker_system)(n, float(penalty), order, errors)
        if system is None:
            return None
        factor, trace, lengths = system
        model._finish(banded_solve(*factor, y[places]), trace)
        if errors:
            model.errors = np.empty(n)
            model.errors[places] = model.sigma * lengths
        return model

    def _at(self, q, values, policy):
        x = self.sorted_x
        if len(x) < 2:
            return self._outside(q, values, policy, np.nan)
        low = np.clip(np.searchsorted(x, q, side="right") - 1, 0, len(x) - 2)
        width = x[low + 1] - x[low]
        t = np.where(width > 0, (q - x[low]) / np.where(width > 0, width, 1), 0.0)
        return self._outside(q, values, policy, values[low] * (1 - t) + values[low + 1] * t)

    def gradient(self, queries):
        q, x, z = np.asarray(queries, float).reshape(-1), self.sorted_x, self.fitted[self.order]
        if len(x) < 2:
            return np.full((len(q), 1), np.nan)
        low = np.clip(np.searchsorted(x, q, side="right") - 1, 0, len(x) - 2)
        width = x[low + 1] - x[low]
        ok = (q >= x[0]) & (q <= x[-1]) & (width > 0)
        return np.where(ok, (z[low + 1] - z[low]) / np.where(width > 0, width, 1), np.nan)[:, None]


def total_variation(y: np.ndarray, penalty: float) -> np.ndarray:
    """The exact minimiser of 0.5 |y - x|^2 + penalty sum |x[i + 1] - x[i]|, by the taut string.

    The running sums of x form the shortest string from (0, 0) to (n, sum y) in the tube of `penalty` about those of y;
    it is traced with the least majorant and greatest minorant of the tube's walls from the last bend.
    """
    n = len(y)
    if penalty <= 0 or n < 2:
        return np.array(y, float)
    total = np.r_[0.0, np.cumsum(y)]
    low, high = total - penalty, total + penalty
    low[0] = high[0] = 0.0
    low[n] = high[n] = total[n]
    x = np.empty(n)
    at, height = 0, 0.0
    floor, roof = [(0, 0.0)], [(0, 0.0)]  # hulls: concave over the floor, convex under the roof

    def slope(p, q):
        return (q[1] - p[1]) / (q[0] - p[0])

    i = 1
    while at < n:
        lower, upper = (i, low[i]), (i, high[i])
        while len(floor) > 1 and slope(floor[-2], floor[-1]) <= slope(floor[-1], lower):
            floor.pop()
        floor.append(lower)
        while len(roof) > 1 and slope(roof[-2], roof[-1]) >= slope(roof[-1], upper):
            roof.pop()
        roof.append(upper)
        bent = False
        while len(floor) > 1 and len(roof) > 1 and slope(floor[0], floor[1]) > slope(roof[0], roof[1]):
            hull = roof if floor[-1][0] == i and len(floor) == 2 else floor  # the wall that was hit first bends the string
            if len(roof) == 2 and len(floor) > 2:
                hull = floor
            bend = hull[1]
            x[at:bend[0]] = (bend[1] - height) / (bend[0] - at)
            at, height = bend
            floor, roof, bent = [bend], [bend], True
            break
        if bent:
            i = at + 1
            continue
        if i == n:
            hull = floor if len(floor) > 2 else roof
            bend = hull[1]
            x[at:bend[0]] = (bend[1] - height) / (bend[0] - at)
            at, height = bend
            floor, roof = [bend], [bend]
            i = at + 1
            continue
        i += 1
    return x


@dataclass
class TotalVariation(Sequence):
    """Piecewise constant smoothing; the trace counts segments, jumps above 1e-6 of the range of y (1 at least)."""

    @classmethod
    def fit(cls, x, y, penalty=0.5, row_ids=None):
        ready = cls.prepare(x, y)
        if ready is None or not (np.isfinite(penalty) and penalty >= 0):
            return None
        x, y, places = ready
        model = cls(x, y, penalty, np.arange(len(y)) if row_ids is None else np.asarray(row_ids), places)
        ordered = total_variation(y[places], penalty)
        jump = 1e-6 * max(1.0, float(y.max() - y.min()))
        model._finish(ordered, 1 + int((np.abs(np.diff(ordered)) > jump).sum()))
        model.errors = np.full(len(y), model.sigma)
        return model

    def _at(self, q, values, policy):
        x = self.sorted_x
        high = np.clip(np.searchsorted(x, q, side="left"), 0, len(x) - 1)
        low = np.maximum(high - 1, 0)
        nearer = np.where((high > 0) & (q - x[low] <= x[high] - q), low, high)
        return self._outside(q, values, policy, values[nearer])

    def gradient(self, queries):
        q, x = np.asarray(queries, float).reshape(-1), self.sorted_x
        return np.where((q >= x[0]) & (q <= x[-1]), 0.0, np.nan)[:, None]


def select_penalty(kind, x, y, penalties, **options):
    """The fit whose generalised cross-validation score is smallest, the first of equal ones; None if none fits."""
    fits = [f for f in (kind.fit(x, y, penalty=p, **options) for p in penalties) if f is not None]
    return min(fits, key=lambda f: f.gcv(), default=None)
