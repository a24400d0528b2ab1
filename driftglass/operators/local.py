"""Local regression: LOESS, Nadaraya-Watson, adaptive LOESS and local likelihood.

A fit holds its training rows (bounded, see `sources.training_arrays`) and numbers for each; evaluation at query points is
vectorised over them, so a DataFrame of queries is evaluated partition by partition with the model broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .families import FAMILIES, Family
from .neighbours import basis, basis_size, bisquare, blocks, locality, nearest, neighbour_count, solve_local

def whole(function, n: int):
    """function(rows) over rows 0 … n - 1 at once; plans.concurrent.in_tasks gives one that spreads blocks of rows over tasks."""
    return function(np.arange(n))


POLICIES = ("polynomial", "nearest", "unavailable")


def inside_box(train: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Whether queries are within the training rows' ranges, ends included."""
    return ((queries >= train.min(axis=0)) & (queries <= train.max(axis=0))).all(axis=1)


def robust_weights(y: np.ndarray, fitted: np.ndarray) -> np.ndarray:
    """Bisquare weights of absolute residuals over six times their median, which has a floor of 1e-8 of y's own spread."""
    scale = max(float(np.median(np.abs(y - np.median(y)))), 1e-300)
    residual = np.abs(y - fitted)
    return bisquare(residual / (6 * max(float(np.median(residual)), 1e-8 * scale)))


def _local(x, y, degree, robust, queries, k, own=None):
    """Values, leverages (of row own[i] in query i) and coefficients (nan where there is no polynomial) of local fits.

    Without positive weights the locality mean, without any locality the nearest response; degree 0 or one row a weighted
    mean; a rank-deficient design a weighted mean without leverage.
    """
    m, p = queries.shape
    q = basis_size(degree, p)
    value, leverage, coefficients = np.empty(m), np.zeros(m), np.full((m, q), np.nan)
    counts = np.broadcast_to(np.asarray(k), (m,))
    for size in np.unique(counts):
        group = np.flatnonzero(counts == size)
        for part in blocks(len(group), max(int(size) * q, len(x) * (1 if p == 1 else p))):
            rows = group[part]
            at, d = nearest(x, queries[rows], int(size))
            near, _ = locality(d)
            w, yy = near * robust[at], y[at]
            some, total, near_total = (w > 0).any(axis=1), w.sum(axis=1), near.sum(axis=1)
            mean = (w * yy).sum(axis=1) / np.where(some, total, 1)
            plain = np.where(near_total > 0, (near * yy).sum(axis=1) / np.where(near_total > 0, near_total, 1), yy[:, 0])
            v, lev = np.where(some, mean, plain), np.zeros(len(rows))
            mine = (at == own[rows][:, None]) if own is not None else None
            averaged = some & ((w > 0).sum(axis=1) == 1) if degree else some
            if mine is not None:
                lev = np.where(averaged, (w * mine).sum(axis=1) / np.where(some, total, 1), 0.0)
            if degree:
                ok, beta, kernel = solve_local(basis(x[at] - queries[rows][:, None, :], degree), w, yy)
                use = some & ok & ~averaged
                v = np.where(use, beta[:, 0], v)
                if mine is not None:
                    lev = np.where(use, (kernel * mine).sum(axis=1), lev)
                coefficients[rows[some & ok]] = beta[some & ok]
            else:
                coefficients[rows[some], 0] = mean[some]
            value[rows], leverage[rows] = v, lev
    return value, leverage, coefficients


def _kernel_error(x, degree, sigma, queries, k):
    """sigma times the length of the equivalent kernel, by locality weights alone; nan where it does not exist."""
    m, p = queries.shape
    out = np.full(m, np.nan)
    counts = np.broadcast_to(np.asarray(k), (m,))
    for size in np.unique(counts):
        group = np.flatnonzero(counts == size)
        for part in blocks(len(group), max(int(size) * basis_size(degree, p), len(x) * (1 if p == 1 else p))):
            rows = group[part]
            at, d = nearest(x, queries[rows], int(size))
            w, _ = locality(d)
            some = (w > 0).any(axis=1)
            if degree == 0:
                total = np.where(some, w.sum(axis=1), 1)
                length = np.sqrt(((w / total[:, None]) ** 2).sum(axis=1))
            else:
                # The spread of responses does not depend on w beyond the design: the plain row products count.
                design = basis(x[at] - queries[rows][:, None, :], degree)
                gram = np.einsum("mka,mk,mkb->mab", design, w, design)
                ok = np.linalg.matrix_rank(gram) == gram.shape[1]
                e1 = np.zeros((len(rows), gram.shape[1], 1))
                e1[:, 0] = 1
                column = np.linalg.solve(np.where(ok[:, None, None], gram, np.eye(gram.shape[1])), e1)[:, :, 0]
                length = np.sqrt((np.einsum("mka,ma->mk", design, column) ** 2 * (w > 0)).sum(axis=1))
                some = some & ok
            out[rows] = np.where(some, sigma * length, np.nan)
    return out


def _policy(x, queries, policy):
    """(queries to evaluate, mask of those that stay without a value): the nearest policy moves outside queries to a training row."""
    if policy not in POLICIES:
        raise ValueError(f"unknown extrapolation policy {policy!r}")
    bad = ~np.isfinite(queries).all(axis=1)
    moved = np.where(bad[:, None], x[0], queries)
    outside = ~inside_box(x, moved)
    if policy == "nearest" and outside.any():
        moved = moved.copy()
        moved[outside] = x[nearest(x, moved[outside], 1)[0][:, 0]]
    return moved, bad | (outside if policy == "unavailable" else False), outside


@dataclass
class Loess:
    """Robust local polynomial regression of degree 0, 1 or 2."""

    x: np.ndarray
    y: np.ndarray
    span: float
    degree: int
    row_ids: np.ndarray
    fitted: np.ndarray = field(default=None)
    weights: np.ndarray = field(default=None)
    leverage: np.ndarray = field(default=None)
    sigma: float = 0.0
    trace: float = 0.0
    family = "gaussian"

    @property
    def k(self) -> int:
        return neighbour_count(len(self.x), self.span, basis_size(self.degree, self.x.shape[1]) + 1)

    @classmethod
    def fit(cls, x, y, span=0.75, degree=2, robust_iterations=4, row_ids=None, each=whole):
        """None if the arguments or values do not allow a fit. Weights are updated robust_iterations + 1 times, then used; `each` runs the passes."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        if not _fits(x, y) or not 0 < span <= 1 or degree not in (0, 1, 2):
            return None
        model = cls(x, y, span, degree, np.arange(len(x)) if row_ids is None else np.asarray(row_ids))
        if model.k < 2:
            return None
        robust, k = np.ones(len(x)), model.k
        for _ in range(robust_iterations + 1):
            robust = robust_weights(y, each(lambda rows, robust=robust: _local(x, y, degree, robust, x[rows], k)[0], len(x)))
        model.fitted, model.leverage = each(lambda rows: _local(x, y, degree, robust, x[rows], k, rows)[:2], len(x))
        model.weights = robust
        model._finish()
        return model

    def _finish(self):
        self.trace = float(self.leverage.sum())
        self.sigma = float(np.sqrt(((self.y - self.fitted) ** 2).sum() / max(len(self.y) - self.trace, 1)))

    def gcv(self) -> float:
        n = len(self.y)
        return float(((self.y - self.fitted) ** 2).sum() / n / max(1 - self.trace / n, 1e-6) ** 2)

    def counts(self, queries: np.ndarray, fast: bool = False):
        """Neighbours of query points: those of the span, 1 at least (the floor of a fit does not count here)."""
        return neighbour_count(len(self.x), self.span, 1)

    def predict(self, queries, policy="polynomial", fast=False):
        queries = np.asarray(queries, float).reshape(-1, self.x.shape[1])
        moved, missing, outside = _policy(self.x, queries, policy)
        value = _local(self.x, self.y, self.degree, self.weights, moved, self.counts(moved, fast))[0]
        if policy == "nearest" and outside.any():
            value[outside] = self.fitted[nearest(self.x, moved[outside], 1)[0][:, 0]]
        return np.where(missing, np.nan, value)

    def standard_error(self, queries, policy="polynomial", fast=False):
        queries = np.asarray(queries, float).reshape(-1, self.x.shape[1])
        moved, missing, _ = _policy(self.x, queries, policy)
        return np.where(missing, np.nan, _kernel_error(self.x, self.degree, self.sigma, moved, self.counts(moved, fast)))

    def gradient(self, queries):
        """(queries x p) slopes of the local fits; nan for degree 0 and degenerate neighbourhoods."""
        queries = np.asarray(queries, float).reshape(-1, self.x.shape[1])
        p = queries.shape[1]
        if self.degree == 0:
            return np.full((len(queries), p), np.nan)
        moved, missing, _ = _policy(self.x, queries, "polynomial")
        slopes = _local(self.x, self.y, self.degree, self.weights, moved, self.counts(moved))[2][:, 1:p + 1]
        return np.where(missing[:, None], np.nan, slopes)


def _fits(x, y) -> bool:
    return x.ndim == 2 and len(x) == len(y) > 0 and bool(np.isfinite(x).all()) and bool(np.isfinite(y).all())


@dataclass
class NadarayaWatson(Loess):
    """The kernel mean: local regression of degree 0 with at least two neighbours. Its gradient follows the bandwidth too."""

    @property
    def k(self) -> int:
        return neighbour_count(len(self.x), self.span, 2)

    def counts(self, queries, fast=False):
        return self.k

    @classmethod
    def fit(cls, x, y, span=0.75, robust_iterations=4, row_ids=None, degree=0, each=whole):
        return super().fit(x, y, span, 0, robust_iterations, row_ids, each)

    def gradient(self, queries):
        queries = np.asarray(queries, float).reshape(-1, self.x.shape[1])
        out = np.full(queries.shape, np.nan)
        fine = np.flatnonzero(np.isfinite(queries).all(axis=1))
        for part in blocks(len(fine), self.k * queries.shape[1] + len(self.x)):
            rows = fine[part]
            at, d = nearest(self.x, queries[rows], self.k)
            h = d.max(axis=1)
            safe_h, safe_d = np.where(h > 0, h, 1.0), np.where(d > 0, d, 1.0)
            u = d / safe_h[:, None]
            away = (queries[rows][:, None, :] - self.x[at]) / safe_d[..., None] * (d > 0)[..., None]  # of the distance
            farthest = np.take_along_axis(away, d.argmax(axis=1)[:, None, None], axis=1)  # of the bandwidth
            slope = np.where((u > 0) & (u < 1), -9 * u**2 * (1 - u**3) ** 2, 0.0) / safe_h[:, None]
            dw = slope[..., None] * (away - u[..., None] * farthest)
            w = locality(d)[0] * self.weights[at]
            total = w.sum(axis=1)
            ok = (h > 0) & (total > 0)
            mean = (w * self.y[at]).sum(axis=1) / np.where(ok, total, 1)
            dw = dw * (self.weights[at] * (w > 0))[..., None]
            g = (dw * (self.y[at] - mean[:, None])[..., None]).sum(axis=1) / np.where(ok, total, 1)[:, None]
            out[rows] = np.where(ok[:, None], g, np.nan)
        return out


@dataclass
class AdaptiveLoess(Loess):
    """Local regression whose neighbourhood at each point has the smallest corrected Akaike score."""

    candidates: np.ndarray = field(default=None)
    selected: np.ndarray = field(default=None)
    bandwidths: np.ndarray = field(default=None)

    @staticmethod
    def grid(n: int, least: int) -> list[int]:
        """Sizes growing by 1.6 from `least`, at most eight, and n."""
        if least > n:
            return []
        sizes = [least]
        while len(sizes) < 8 and sizes[-1] < n:
            sizes.append(min(n, max(sizes[-1] + 1, int(np.floor(sizes[-1] * 1.6 + 0.5)))))
        return sizes if sizes[-1] == n else [*sizes, n]

    def select(self, queries: np.ndarray) -> np.ndarray:
        """The size of the smallest score for each query, the larger of equal ones; the largest where no design has full rank."""
        x, y, q = self.x, self.y, basis_size(self.degree, self.x.shape[1])
        best, score = np.full(len(queries), self.candidates[-1]), np.full(len(queries), np.inf)
        for k in self.candidates:
            k = int(k)
            for part in blocks(len(queries), max(k * q, len(x) * (1 if x.shape[1] == 1 else x.shape[1]))):
                at, d = nearest(x, queries[part], k)
                w, _ = locality(d)
                design = basis(x[at] - queries[part][:, None, :], self.degree)
                ok, beta, _ = solve_local(design, w, y[at])
                rss = ((y[at] - np.einsum("mkq,mq->mk", design, beta)) ** 2 * (w > 0)).sum(axis=1)
                with np.errstate(divide="ignore"):
                    now = np.log(rss / k) + (2 * q + 2 * q * (q + 1) / (k - q - 1)) / k
                better = ok & (now <= score[part])
                score[part] = np.where(better, now, score[part])
                best[part] = np.where(better, k, best[part])
        return best

    def counts(self, queries, fast=False):
        if fast:  # borrow the size of the nearest training row
            return self.selected[nearest(self.x, queries, 1)[0][:, 0]]
        return self.select(queries)

    @classmethod
    def fit(cls, x, y, degree=2, neighbourhoods=None, robust_iterations=4, row_ids=None, each=whole):
        x, y = np.asarray(x, float), np.asarray(y, float)
        if not _fits(x, y) or degree not in (0, 1, 2):
            return None
        n, least = len(x), basis_size(degree, x.shape[1]) + 2
        sizes = sorted({k for k in (neighbourhoods if neighbourhoods is not None else cls.grid(n, least)) if least <= k <= n})
        if not sizes:
            return None
        model = cls(x, y, 1.0, degree, np.arange(n) if row_ids is None else np.asarray(row_ids), candidates=np.array(sizes))
        model.selected = each(lambda rows: model.select(x[rows]), n)
        sized, robust = model.selected, np.ones(n)
        fitted = each(lambda rows: _local(x, y, degree, robust, x[rows], sized[rows])[0], n)
        for _ in range(robust_iterations):
            robust = robust_weights(y, fitted)
            fitted = each(lambda rows, robust=robust: _local(x, y, degree, robust, x[rows], sized[rows])[0], n)
        model.fitted, model.leverage = each(lambda rows: _local(x, y, degree, robust, x[rows], sized[rows], rows)[:2], n)
        model.weights = robust
        model.bandwidths = np.empty(n)
        for k in np.unique(model.selected):  # one search for each size
            rows = np.flatnonzero(model.selected == k)
            for part in blocks(len(rows), max(int(k), len(x) * (1 if x.shape[1] == 1 else x.shape[1]))):
                model.bandwidths[rows[part]] = nearest(x, x[rows[part]], int(k))[1].max(axis=1)
        model._finish()
        return model


@dataclass
class LocalLikelihood:
    """Local polynomial fits of the link by weighted likelihood: gaussian, binomial or poisson.

    The gaussian link is the identity without bounds.
    """

    x: np.ndarray
    y: np.ndarray
    degree: int
    span: float
    family: str
    row_ids: np.ndarray
    fitted: np.ndarray = field(default=None)
    eta: np.ndarray = field(default=None)
    sigma: float = 1.0
    trace: float = 0.0
    deviance: float = 0.0
    null_deviance: float = 0.0

    @property
    def k(self) -> int:
        return neighbour_count(len(self.x), self.span, basis_size(self.degree, self.x.shape[1]) + 1)

    @classmethod
    def fit(cls, x, y, degree=2, family="gaussian", span=0.75, row_ids=None, each=whole):
        x, y = np.asarray(x, float), np.asarray(y, float)
        if not _fits(x, y) or not 0 < span <= 1 or degree not in (0, 1, 2) or not FAMILIES[family].allows(y):
            return None
        model = cls(x, y, degree, span, family, np.arange(len(x)) if row_ids is None else np.asarray(row_ids))
        if model.k < 2:
            return None
        own = FAMILIES[family]
        model.fitted, model.eta, _, corner = each(lambda rows: model._points(x[rows]), len(x))
        dmu, variance = own.working(model.eta)[1:]
        model.trace = float(np.where(np.isnan(corner), 0, dmu**2 / variance * np.nan_to_num(corner)).sum())
        if family == "gaussian":
            model.sigma = float(np.sqrt(((y - model.fitted) ** 2).sum() / max(len(y) - model.trace, 1)))
        model.deviance = float(own.deviance(y, model.fitted).sum())
        model.null_deviance = float(own.deviance(y, np.full(len(y), own.bounded_mean(y.mean()))).sum())
        return model

    def aic(self) -> float:
        return self.deviance + 2 * self.trace

    def _points(self, queries):
        """Means, links, coefficients (nan rows where a bounded mean stands in) and the corner of the inverse information."""
        family = FAMILIES[self.family]
        m, p = queries.shape
        q = basis_size(self.degree, p)
        mu, eta, betas, corner = np.empty(m), np.empty(m), np.full((m, q), np.nan), np.full(m, np.nan)
        for part in blocks(m, max(self.k * q * q, len(self.x) * (1 if p == 1 else p))):
            at, d = nearest(self.x, queries[part], self.k)
            w, _ = locality(d)
            design, y = basis(self.x[at] - queries[part][:, None, :], self.degree), self.y[at]
            ok, beta, inverse = _local_newton(design, y, w, family, family.start(self.y.mean()))
            total = w.sum(axis=1)
            mean = np.where(total > 0, (w * y).sum(axis=1) / np.where(total > 0, total, 1), y[:, 0])
            mu[part] = np.where(ok, family.mean(beta[:, 0]), mean)
            eta[part] = np.where(ok, beta[:, 0], family.fallback(mean))
            betas[part] = np.where(ok[:, None], beta, np.nan)
            corner[part] = np.where(ok, inverse, np.nan)
        return mu, eta, betas, corner

    def predict(self, queries, policy="polynomial", fast=False):
        queries = np.asarray(queries, float).reshape(-1, self.x.shape[1])
        moved, missing, outside = _policy(self.x, queries, policy)
        value = self._points(moved)[0]
        if policy == "nearest" and outside.any():
            value[outside] = self.fitted[nearest(self.x, moved[outside], 1)[0][:, 0]]
        return np.where(missing, np.nan, value)

    def standard_error(self, queries, policy="polynomial", fast=False):
        """|dmu/deta| times the root of the inverse information's corner, on the scale of the mean."""
        queries = np.asarray(queries, float).reshape(-1, self.x.shape[1])
        moved, missing, _ = _policy(self.x, queries, policy)
        _, eta, _, corner = self._points(moved)
        return np.where(missing, np.nan, np.abs(FAMILIES[self.family].working(eta)[1]) * np.sqrt(np.maximum(corner, 0)))

    def gradient(self, queries):
        queries = np.asarray(queries, float).reshape(-1, self.x.shape[1])
        if self.degree == 0:
            return np.full(queries.shape, np.nan)
        moved, missing, _ = _policy(self.x, queries, "polynomial")
        _, eta, betas, _ = self._points(moved)
        g = FAMILIES[self.family].working(eta)[1][:, None] * betas[:, 1:1 + queries.shape[1]]
        return np.where(missing[:, None], np.nan, g)


def _spd(a: np.ndarray) -> np.ndarray:
    """Which matrices of a stack are positive definite."""
    ok = np.isfinite(a).all(axis=(1, 2))
    low = np.linalg.eigvalsh(np.where(ok[:, None, None], a, np.eye(a.shape[1])))
    return ok & (low[:, 0] > 1e-13 * np.maximum(low[:, -1], 1e-300))


def _local_newton(design, y, w, family: Family, start: float):
    """Newton steps (at most 25, halved down to 1/1024 while the deviance does not fall) for a stack of local problems.

    (ok, coefficients, corner of the inverse information at the solution).
    """
    m, _, q = design.shape
    beta = np.zeros((m, q))
    beta[:, 0] = start

    def deviance(b, rows):
        mu = family.working(np.einsum("mkq,mq->mk", design[rows], b))[0]
        return (w[rows] * family.deviance(y[rows], mu)).sum(axis=1)

    def information(b, rows):
        eta = np.einsum("mkq,mq->mk", design[rows], b)
        mu, dmu, variance = family.working(eta)
        weight = w[rows] * dmu**2 / variance
        return np.einsum("mka,mk,mkb->mab", design[rows], weight, design[rows]), np.einsum("mka,mk->ma", design[rows], weight * (eta + (y[rows] - mu) / dmu))

    active, settled = np.arange(m), np.zeros(m, bool)
    now = deviance(beta, active)
    for _ in range(25):
        if not len(active):
            break
        gram, right = information(beta[active], active)
        good = _spd(gram)
        active, gram, right = active[good], gram[good], right[good]
        if not len(active):
            break
        goal = np.linalg.solve(gram, right[..., None])[..., 0]
        step, better = np.ones(len(active)), np.zeros(len(active), bool)
        trial, trial_dev = beta[active].copy(), now[active].copy()
        while len(rest := np.flatnonzero(~better & (step >= 1 / 1024))):
            t = beta[active[rest]] + step[rest, None] * (goal[rest] - beta[active[rest]])
            dev = deviance(t, active[rest])
            fell = dev < now[active[rest]]
            trial[rest[fell]], trial_dev[rest[fell]], better[rest[fell]] = t[fell], dev[fell], True
            step[rest[~fell]] /= 2
        close = better & (np.abs(now[active] - trial_dev) <= 1e-8 * np.maximum(1, np.abs(now[active])))
        beta[active[better]], now[active[better]] = trial[better], trial_dev[better]
        settled[active[~better | close]] = True
        active = active[better & ~close]
    corner = np.full(m, np.nan)
    done = np.flatnonzero(settled)
    if len(done):
        gram, _ = information(beta[done], done)
        good = _spd(gram)
        e1 = np.zeros((len(done), q, 1))
        e1[:, 0] = 1
        corner[done] = np.where(good, np.linalg.solve(np.where(good[:, None, None], gram, np.eye(q)), e1)[:, 0, 0], np.nan)
    return settled, beta, corner
