"""Additive and multivariate models of gaussian, binomial or poisson responses by penalized likelihood, fitted where the rows are.

Terms are centred cubic splines, tensor products of two of them and treatment-coded categories. The coefficients minimise
deviance / 2 + penalty * |coefficients without the intercept|^2. The bound columns are written to the shared folder and read once for
ranges, then once in all for a gaussian response (its sums of products say everything) or once for means and once per step: each
partition sums its part of the information matrix, the score and the deviance in numpy, and the driver solves a
system of the number of coefficients (at most 1024), so the rows never move. Categories are never spelt out as columns: their
sums are counts by code. Designs that count as sparse are solved by conjugate gradients, others directly.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.generators import counts
from ..sources.staging import stage, unstage, with_ranks
from .families import FAMILIES

#: Limits (fixed values): columns of a dense or any model, of exact inference; size and density from which a design counts as sparse.
DENSE_COLUMNS, MOST_COLUMNS, EXACT_COLUMNS, SPARSE_CELLS, SPARSE_DENSITY = 256, 1024, 256, 250_000, 0.12


@dataclass(frozen=True)
class Spline:
    """[u, u^2, u^3, (u - j / (knots + 1))+^3 ...] with u the predictor scaled to 0..1 on the training range."""

    predictor: int
    knots: int = 3


@dataclass(frozen=True)
class Tensor:
    """Products of the columns of two (uncentred) splines: the interaction alone."""

    first: int
    second: int
    first_knots: int = 1
    second_knots: int = 1


@dataclass(frozen=True)
class Category:
    """An indicator for each level but the reference: the first listed level, or the smallest found."""

    predictor: int
    levels: tuple[int, ...] | None = None
    reference: int | None = None


@dataclass(frozen=True)
class GlmSpec:
    terms: tuple | None = None
    spatial: Tensor | None = None
    temporal: Spline | None = None
    knots: int = 3
    penalty: float = 1.0
    solver: str = "automatic"  # automatic, denseQR or sparseCGLS
    max_iterations: int = 50
    tolerance: float = 1e-8

    def resolve(self, p: int) -> list | None:
        """The terms in order, None if the specification is not valid for p predictors.

        Without terms every predictor gets a spline. A spatial term brings the splines of its two margins, a temporal
        one its spline, each unless it is there already.
        """
        if not (0 <= self.knots <= 8 and np.isfinite(self.penalty) and self.penalty > 0 and self.max_iterations > 0 and np.isfinite(self.tolerance) and self.tolerance > 0):
            return None
        if self.solver not in ("automatic", "denseQR", "sparseCGLS") or (self.terms is not None and not self.terms and self.spatial is None):
            return None
        terms = [Spline(j, self.knots) for j in range(p)] if self.terms is None else list(self.terms)
        if self.spatial is not None:
            extra = [Spline(self.spatial.first, self.spatial.first_knots), Spline(self.spatial.second, self.spatial.second_knots), self.spatial]
            terms += [t for t in [*extra, *([self.temporal] if self.temporal else [])] if t not in terms]
        for t in terms:
            where = (t.first, t.second) if isinstance(t, Tensor) else (t.predictor,)
            if any(not 0 <= j < p for j in where) or len(set(where)) < len(where):
                return None
            if isinstance(t, Spline) and not 0 <= t.knots <= 8 or isinstance(t, Tensor) and not (0 <= t.first_knots <= 5 and 0 <= t.second_knots <= 5):
                return None
            if isinstance(t, Category) and t.levels is not None and (not 2 <= len(t.levels) <= 1023 or len(set(t.levels)) < len(t.levels) or t.reference is not None and t.reference not in t.levels):
                return None
        return terms if terms and len(set(terms)) == len(terms) else None


@dataclass
class Basis:
    """A term made concrete: ranges of its predictors or its levels, the means that centre its columns, its coefficients."""

    term: object
    ranges: tuple = ()
    levels: np.ndarray | None = None
    reference: int | None = None
    means: np.ndarray | None = None
    at: slice = slice(0, 0)

    @property
    def width(self) -> int:
        t = self.term
        if isinstance(t, Category):
            return len(self.levels)
        return 3 + t.knots if isinstance(t, Spline) else (3 + t.first_knots) * (3 + t.second_knots)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Uncentred columns; categories that are not known give nan."""
        t = self.term
        if isinstance(t, Spline):
            return _cubic(x[:, t.predictor], *self.ranges[0], t.knots)
        if isinstance(t, Tensor):
            a, b = _cubic(x[:, t.first], *self.ranges[0], t.first_knots), _cubic(x[:, t.second], *self.ranges[1], t.second_knots)
            return (a[:, :, None] * b[:, None, :]).reshape(len(x), -1)
        code = x[:, t.predictor]
        out = (code[:, None] == self.levels[None, :]).astype(float)
        out[~((code == self.reference) | out.any(axis=1))] = np.nan
        return out

    def columns(self, x: np.ndarray) -> np.ndarray:
        return self.raw(x) - self.means

    def slopes(self, x: np.ndarray, beta: np.ndarray) -> np.ndarray:
        """(rows x predictors) derivatives of the term's effect; categories have none."""
        out = np.zeros(x.shape)
        t = self.term
        if isinstance(t, Spline):
            out[:, t.predictor] = _cubic_slope(x[:, t.predictor], *self.ranges[0], t.knots) @ beta
        elif isinstance(t, Tensor):
            grid = beta.reshape(3 + t.first_knots, 3 + t.second_knots)
            a, b = _cubic(x[:, t.first], *self.ranges[0], t.first_knots), _cubic(x[:, t.second], *self.ranges[1], t.second_knots)
            out[:, t.first] = np.einsum("ia,ab,ib->i", _cubic_slope(x[:, t.first], *self.ranges[0], t.first_knots), grid, b)
            out[:, t.second] = np.einsum("ia,ab,ib->i", a, grid, _cubic_slope(x[:, t.second], *self.ranges[1], t.second_knots))
        return out


def _cubic(x, low, high, knots):
    u = (x - low) / (high - low)
    return np.stack([u, u**2, u**3, *[np.maximum(u - j / (knots + 1), 0) ** 3 for j in range(1, knots + 1)]], axis=1)


def _cubic_slope(x, low, high, knots):
    u = (x - low) / (high - low)
    return np.stack([np.ones(len(u)), 2 * u, 3 * u**2, *[3 * np.maximum(u - j / (knots + 1), 0) ** 2 for j in range(1, knots + 1)]], axis=1) / (high - low)


def spline_columns(x: Column, low: float, high: float, knots: int) -> list[Column]:
    """The uncentred spline columns as expressions."""
    u = (x - F.lit(low)) / F.lit(high - low)
    return [u, u * u, u * u * u, *[F.pow(F.greatest(u - F.lit(j / (knots + 1)), F.lit(0.0)), F.lit(3.0)) for j in range(1, knots + 1)]]


@dataclass
class GlmModel:
    """A converged model. covariance is of all coefficients (or their variances alone: `diagonal`)."""

    family: str
    bases: list[Basis]
    coefficients: np.ndarray
    ranges: np.ndarray
    n: int
    deviance: float
    null_deviance: float
    objective: float
    penalty: float
    iterations: int
    score: float
    edf: float
    scale: float
    covariance: np.ndarray
    diagonal: bool
    backend: str

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(x), 1)), *[b.columns(x) for b in self.bases]], axis=1)

    def linear_predictor(self, x):
        x = _rows(x, len(self.ranges))
        return np.where(np.isfinite(x).all(axis=1), self.design(x) @ self.coefficients, np.nan)

    def predict(self, x, policy="polynomial", fast=False):
        """Means. The splines go on outside the training ranges whatever the policy; unknown categories give nan."""
        return FAMILIES[self.family].mean(self._bounded(self.linear_predictor(x)))

    def _bounded(self, eta):
        return eta if self.family == "gaussian" else np.clip(eta, -30, 30)

    def contributions(self, x):
        """(rows x terms) centred effects on the scale of the link."""
        x = _rows(x, len(self.ranges))
        return np.stack([b.columns(x) @ self.coefficients[b.at] for b in self.bases], axis=1)

    def gradient(self, x):
        """Derivatives of the mean by each predictor."""
        x = _rows(x, len(self.ranges))
        slope = FAMILIES[self.family].working(self.linear_predictor(x))[1]
        return slope[:, None] * sum(b.slopes(x, self.coefficients[b.at]) for b in self.bases)

    def link_error(self, x):
        d = self.design(_rows(x, len(self.ranges)))
        v = (d**2) @ self.covariance if self.diagonal else np.einsum("ij,jk,ik->i", d, self.covariance, d)
        return np.sqrt(np.maximum(v, 0))

    def standard_error(self, x, policy="polynomial", fast=False):
        return np.abs(FAMILIES[self.family].working(self.linear_predictor(x))[1]) * self.link_error(x)

    def interval(self, x, level=0.95):
        """(low, high) for the mean: an interval of the link carried through it."""
        z = NormalDist().inv_cdf(0.5 + level / 2)
        eta, e = self.linear_predictor(x), self.link_error(x)
        mean = FAMILIES[self.family].mean
        return mean(self._bounded(eta - z * e)), mean(self._bounded(eta + z * e))

    def partial_effect(self, term: int, count=100, level=None):
        """A frame (predictor, x, effect, grad, lo, hi) of a spline term along its range, on the scale of the link."""
        b = self.bases[term]
        if not isinstance(b.term, Spline) or count < 2:
            return None
        j, (low, high) = b.term.predictor, b.ranges[0]
        x = np.tile(self.ranges.mean(axis=1), (count, 1))
        x[:, j] = low + (high - low) * np.arange(count) / (count - 1)
        c = b.columns(x)
        out = pd.DataFrame({"predictor": j, "x": x[:, j], "effect": c @ self.coefficients[b.at], "grad": b.slopes(x, self.coefficients[b.at])[:, j]})
        if level is not None:
            own = self.covariance[b.at] if self.diagonal else self.covariance[b.at, b.at]
            v = (c**2) @ own if self.diagonal else np.einsum("ij,jk,ik->i", c, own, c)
            e = NormalDist().inv_cdf(0.5 + level / 2) * np.sqrt(np.maximum(v, 0))
            out["lo"], out["hi"] = out.effect - e, out.effect + e
        return out

    def term_diagnostics(self) -> list[dict]:
        """For each spline term: its predictor, size, share of the degrees of freedom's columns, and the range of its effect on the link over the training range."""
        out = []
        for k, b in enumerate(self.bases):
            if isinstance(b.term, Spline):
                effect = self.partial_effect(k, 100)["effect"].to_numpy()
                out.append({"predictor": b.term.predictor, "columns": b.width, "rms": float(np.sqrt((effect**2).mean())), "min": float(effect.min()), "max": float(effect.max())})
        return out

    def diagnostics(self) -> dict:
        return {"family": self.family, "link": FAMILIES[self.family].link, "n": self.n, "edf": self.edf, "scale": self.scale, "deviance": self.deviance, "null_deviance": self.null_deviance}

    def contour(self, x: int, y: int, baseline, x_count=50, y_count=50):
        """A frame (yi, xi, x, y, value) over the two predictors' ranges, the others at the baseline; None if a value is not finite."""
        baseline = np.asarray(baseline, float)
        if x == y or min(x_count, y_count) < 2 or len(baseline) != len(self.ranges) or not np.isfinite(baseline).all() or (np.ptp(self.ranges[[x, y]], axis=1) <= 0).any():
            return None
        xs = np.linspace(*self.ranges[x], x_count)
        ys = np.linspace(*self.ranges[y], y_count)
        yi, xi = np.divmod(np.arange(x_count * y_count), x_count)
        rows = np.tile(baseline, (len(xi), 1))
        rows[:, x], rows[:, y] = xs[xi], ys[yi]
        value = self.predict(rows)
        return pd.DataFrame({"yi": yi, "xi": xi, "x": xs[xi], "y": ys[yi], "value": value}) if np.isfinite(value).all() else None


def _rows(x, p):
    return np.asarray(x, float).reshape(-1, p)


@dataclass
class GlmResult:
    """How a fit ended; the model is there only if it converged. sparse: what the solver's choice rests on."""

    status: str
    iterations: int = 0
    deviance: float | None = None
    objective: float | None = None
    score: float | None = None
    model: GlmModel | None = None
    evidence: dict = field(default_factory=dict)

    @property
    def converged(self) -> bool:
        return self.status == "converged" and self.model is not None


def sparse_choice(n: int, p: int, density: float, solver: str = "automatic") -> bool:
    """Whether a design of n rows and p columns counts as sparse."""
    return solver == "sparseCGLS" or solver == "automatic" and n * p >= SPARSE_CELLS and density <= SPARSE_DENSITY


@dataclass
class Layout:
    """Where the columns of a design are: dense ones (the intercept and the splines') and the slices of categories."""

    bases: list[Basis]
    size: int

    def __post_init__(self):
        self.smooth = [b for b in self.bases if not isinstance(b.term, Category)]
        self.factors = [b for b in self.bases if isinstance(b.term, Category)]
        self.dense = np.r_[0, *[np.arange(b.at.start, b.at.stop) for b in self.smooth]].astype(int)

    def parts(self, x: np.ndarray, centred: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        """Dense columns, and for each factor the place of each row's level (its width stands for the reference)."""
        columns = np.concatenate([np.ones((len(x), 1)), *[b.columns(x) if centred else b.raw(x) for b in self.smooth]], axis=1)
        codes = []
        for b in self.factors:
            value, order = x[:, b.term.predictor], np.argsort(b.levels)
            at = np.minimum(np.searchsorted(b.levels[order], value), b.width - 1)
            codes.append(np.where(value == b.reference, b.width, order[at]))
        return columns, codes

    def linear(self, parts, beta: np.ndarray) -> np.ndarray:
        columns, codes = parts
        return columns @ beta[self.dense] + sum(np.r_[beta[b.at], 0.0][code] for b, code in zip(self.factors, codes))

    def score(self, parts, r: np.ndarray) -> np.ndarray:
        """The design's transpose times r."""
        columns, codes = parts
        out = np.zeros(self.size)
        out[self.dense] = columns.T @ r
        for b, code in zip(self.factors, codes):
            out[b.at] = np.bincount(code, r, b.width + 1)[:-1]
        return out

    def gram(self, parts, w: np.ndarray) -> np.ndarray:
        """The weighted sums of products of all columns."""
        columns, codes = parts
        out = np.zeros((self.size, self.size))
        weighted = columns * w[:, None]
        out[np.ix_(self.dense, self.dense)] = weighted.T @ columns
        for k, (b, code) in enumerate(zip(self.factors, codes)):
            for place, column in zip(self.dense, weighted.T):
                out[b.at, place] = out[place, b.at] = np.bincount(code, column, b.width + 1)[:-1]
            out[b.at, b.at] = np.diag(np.bincount(code, w, b.width + 1)[:-1])
            for c, other in zip(self.factors[:k], codes[:k]):
                both = np.bincount(code * (c.width + 1) + other, w, (b.width + 1) * (c.width + 1)).reshape(b.width + 1, c.width + 1)[:-1, :-1]
                out[b.at, c.at], out[c.at, b.at] = both, both.T
        return out


def _sums(data: DataFrame, features: list[str], response: str, function, size: int) -> np.ndarray:
    """The sum over all rows of function(x, y), a flat array of `size` numbers, added up per partition and then in a tree, sixteen sums a task."""
    columns = [F.col(f"`{c}`").cast("double") for c in [*features, response]]

    def partial(batches):
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                values = batch.to_numpy(float)
                total += function(values[:, :-1], values[:, -1])
        yield pd.DataFrame({"part": [total.tobytes()]})

    def add(frames):
        total = np.zeros(size)
        for frame in frames:
            for part in frame["part"]:
                total += np.frombuffer(part)
        yield pd.DataFrame({"part": [total.tobytes()]})

    rows = data.select(*columns)
    parts, count = rows.mapInPandas(partial, "part binary"), rows.rdd.getNumPartitions()
    while count > 16:
        count = -(-count // 16)
        parts = parts.repartition(count).mapInPandas(add, "part binary")
    return sum((np.frombuffer(r.part) for r in parts.collect()), np.zeros(size))  # sixteen sums at most


def conjugate_gradients(matrix: np.ndarray, right: np.ndarray, tolerance: float = 1e-13, limit: int | None = None) -> tuple[np.ndarray, dict]:
    """(solution, how it went) of a positive definite system, scaled by its diagonal: what least squares by conjugate gradients does, on normal equations."""
    scale = 1 / np.sqrt(np.diag(matrix))
    a, b = matrix * scale[:, None] * scale[None, :], right * scale
    x, r = np.zeros(len(b)), b.copy()
    p, now = r.copy(), float(r @ r)
    goal, limit, done = tolerance * max(float(np.sqrt(b @ b)), 1e-300), limit or 20 * len(b) + 50, 0
    while np.sqrt(now) > goal and done < limit:
        step = a @ p
        length = now / float(p @ step)
        x, r = x + length * p, r - length * step
        now, before = float(r @ r), now
        p, done = r + now / before * p, done + 1
    residual = float(np.abs(right - matrix @ (x * scale)).max())
    return x * scale, {"solver_iterations": done, "solver_residual": residual, "solver_limit": limit, "solver_tolerance": tolerance, "solver_converged": bool(np.sqrt(now) <= goal)}


def fit_glm(data: DataFrame, features: list[str], response: str, family: str, spec: GlmSpec = GlmSpec()) -> GlmResult:
    """Fit to the rows of data whose features and response are all finite.

    Statuses: converged, invalidInput, numericalFailure, lineSearchFailure, iterationLimit.
    """
    from ..sources.binding import finite_rows

    terms = spec.resolve(len(features))
    if terms is None:
        return GlmResult("invalidInput")
    data = finite_rows(data, [*features, response]).select(*[F.col(c).cast("double").alias(c) for c in [*features, response]])
    data = stage(data, "glm")
    try:
        return _fit(data, features, response, family, spec, terms)
    finally:
        unstage(data)


def _fit(data: DataFrame, features: list[str], response: str, family: str, spec: GlmSpec, terms: list) -> GlmResult:
    p, own = len(features), FAMILIES[family]
    y = F.col(response)
    wrong = {"binomial": F.count_if(~y.isin(0.0, 1.0)), "poisson": F.count_if(y < 0), "gaussian": F.lit(0)}[family]
    own_sum = {"gaussian": F.var_pop(y), "poisson": F.sum(F.when(y > 0, y * F.log(y)).otherwise(0.0)), "binomial": F.lit(0.0)}[family]
    first = data.agg(F.count("*"), F.sum(y), wrong, own_sum, *[f(c) for c in features for f in (F.min, F.max)]).head()
    n, total = first[0], first[1]
    if not n or first[2]:
        return GlmResult("invalidInput")
    ranges = np.array(first[4:], float).reshape(p, 2)
    mean = own.bounded_mean(total / n)
    null = {"gaussian": first[3] * n, "poisson": 2 * (first[3] - total * np.log(mean) - total + n * mean) if mean > 0 else 0.0,
            "binomial": -2 * (total * np.log(mean) + (n - total) * np.log(1 - mean)) if 0 < mean < 1 else 0.0}[family]
    bases, at = [], 1
    for t in terms:
        b = Basis(t)
        if isinstance(t, Category):
            column = features[t.predictor]
            found = [r[0] for r in data.select(column).distinct().limit(MOST_COLUMNS + 2).collect()]
            if len(found) > MOST_COLUMNS or any(v != np.floor(v) or abs(v) > 2**53 for v in found):
                return GlmResult("invalidInput")
            levels = [float(v) for v in (t.levels if t.levels is not None else sorted(found))]
            reference = float(t.reference) if t.reference is not None else levels[0]
            if len(levels) < 2 or set(found) - set(levels) or reference not in levels:
                return GlmResult("invalidInput")
            b.levels, b.reference = np.array([v for v in levels if v != reference]), reference
            b.means = np.zeros(len(b.levels))
        else:
            b.ranges = tuple(tuple(ranges[j]) for j in ((t.predictor,) if isinstance(t, Spline) else (t.first, t.second)))
            if any(not high > low for low, high in b.ranges):
                return GlmResult("invalidInput")
        b.at = slice(at, at + b.width)
        at += b.width
        bases.append(b)
    columns = at
    if columns > (DENSE_COLUMNS if spec.solver == "denseQR" else MOST_COLUMNS):
        return GlmResult("invalidInput")
    layout = Layout(bases, columns)
    ridge = np.r_[0.0, np.ones(columns - 1)]
    if family == "gaussian":
        def products(x, y):
            parts = layout.parts(x, centred=False)
            return np.concatenate([layout.gram(parts, np.ones(len(x))).ravel(), layout.score(parts, y)])

        flat = _sums(data, features, response, products, columns**2 + columns)
        raw, right = flat[:columns**2].reshape(columns, columns), flat[columns**2:]
        sums = raw[0]
    else:
        def column_sums(x, _):
            return layout.score(layout.parts(x, centred=False), np.ones(len(x)))

        sums = _sums(data, features, response, column_sums, columns)
    for b in layout.smooth:
        b.means = sums[b.at] / n
    held = n * len(layout.dense) + sum(sums[b.at].sum() for b in layout.factors)
    density = float(held / (n * columns))
    sparse = sparse_choice(n, columns, density, spec.solver)
    told = {"rows": n, "columns": columns, "non_zero": int(round(held)), "density": density, "sparse": sparse, "backend": "sparseCGLS" if sparse else "gram"}

    def solve(matrix, side):
        """The solution, or None if there is none."""
        try:
            if not sparse:
                found = np.linalg.solve(matrix, side)
            else:
                found, how = conjugate_gradients(matrix, side)
                told.update(how)
                if not how["solver_converged"]:
                    return None
        except np.linalg.LinAlgError:
            return None
        return found if np.isfinite(found).all() else None

    if family == "gaussian":
        # Centring is a change of columns: each but the factors' less its mean times the first.
        change = np.eye(columns)
        for b in layout.smooth:
            change[0, b.at] = -b.means
        information, right = change.T @ raw @ change, change.T @ right
        beta = solve(information + np.diag(2 * spec.penalty * ridge), right)
        if beta is None:
            return GlmResult("numericalFailure", evidence=told)
        slope = float(np.abs(right - information @ beta - 2 * spec.penalty * ridge * beta).max())
        away, side = beta - np.r_[total / n, np.zeros(columns - 1)], right - total / n * information[0]  # about the mean, so that little cancels
        deviance = max(float(first[3] * n - 2 * away @ side + away @ information @ away), 0.0)
        objective, iteration = deviance / 2 + spec.penalty * float((ridge * beta**2).sum()), 1
    else:
        def step(beta):
            """(deviance, score of the likelihood, information) at beta."""
            def function(x, y):
                parts = layout.parts(x, centred=True)
                mu, slope, variance = own.working(layout.linear(parts, beta))
                weight = slope**2 / variance
                return np.concatenate([[own.deviance(y, mu).sum()], layout.score(parts, weight * (y - mu) / slope), layout.gram(parts, weight).ravel()])

            flat = _sums(data, features, response, function, 1 + columns + columns**2)
            return flat[0], flat[1:1 + columns], flat[1 + columns:].reshape(columns, columns)

        beta = np.zeros(columns)
        beta[0] = own.start(total / n) if family != "poisson" else float(np.log(max(total / n, 1e-6)))
        deviance, score, information = step(beta)
        objective = deviance / 2 + spec.penalty * (ridge * beta**2).sum()
        size = max(1.0, float(np.abs(score - 2 * spec.penalty * ridge * beta).max()))
        if not np.isfinite(objective) or not np.isfinite(size):
            return GlmResult("numericalFailure", evidence=told)
        for iteration in range(1, spec.max_iterations + 1):
            move = solve(information + np.diag(2 * spec.penalty * ridge), score - 2 * spec.penalty * ridge * beta)
            if move is None:
                return GlmResult("numericalFailure", iteration - 1, deviance, objective, evidence=told)
            for halving in range(20):
                trial = beta + move * 0.5**halving
                now = step(trial)
                value = now[0] / 2 + spec.penalty * (ridge * trial**2).sum()
                if np.isfinite(value) and value <= objective + 1e-12 * max(1, abs(objective)):
                    break
            else:
                return GlmResult("lineSearchFailure", iteration - 1, deviance, objective, evidence=told)
            change = float(np.abs(trial - beta).max())
            beta, objective, (deviance, score, information) = trial, value, now
            slope = float(np.abs(score - 2 * spec.penalty * ridge * beta).max())
            if not np.isfinite(slope):
                return GlmResult("numericalFailure", iteration, deviance, objective, evidence=told)
            if change <= spec.tolerance * max(1, float(np.abs(beta).max())) and slope <= max(spec.tolerance, 1e-7) * size:
                break
        else:
            return GlmResult("iterationLimit", spec.max_iterations, deviance, objective, evidence=told)
    whole = information + np.diag(2 * spec.penalty * ridge)
    diagonal = sparse and columns > EXACT_COLUMNS
    if diagonal:
        covariance = 1 / np.diag(whole)
        edf = float((np.diag(information) / np.diag(whole)).sum())
    else:
        inverse = np.linalg.inv(whole)
        part = inverse @ information
        covariance = part @ inverse
        covariance = (covariance + covariance.T) / 2
        edf = float(np.trace(part))
    if not np.isfinite(covariance).all() or not 1 - 1e-8 <= edf <= columns + 1e-8:
        return GlmResult("numericalFailure", iteration, deviance, objective, slope)
    edf = min(max(edf, 1.0), float(columns))
    scale = float(np.sqrt(deviance / max(n - edf, 1))) if family == "gaussian" else 1.0
    if family == "gaussian":
        covariance = covariance * scale**2
    told["inference"] = "diagonalConditionalApproximation" if diagonal else "exactDenseCovariance"
    model = GlmModel(family, bases, beta, ranges, n, float(deviance), float(null), float(objective), spec.penalty, iteration, slope, edf, scale, covariance, diagonal, told["backend"])
    return GlmResult("converged", iteration, float(deviance), float(objective), slope, model, told)


#: Numbers that the sums of all replicas of one pass may have.
REPLICA_NUMBERS = 2_000_000


def fit_replicas(data: DataFrame, features: list[str], response: str, model: GlmModel, spec: GlmSpec, replicates: int, seed: int, row_id: str | None = None) -> list[np.ndarray | None]:
    """Coefficients of `replicates` refits of a model with resampled rows, None for those that do not settle.

    Replica r counts every row as often as a Poisson draw of mean 1 from (seed, r, place of the row) says, and keeps the model's
    columns. All replicas (in groups, where their sums would be too many) are summed in the same passes over the rows, starting at the model's
    coefficients, so a pass serves all and none moves a row.
    """
    from ..sources.binding import finite_rows

    rows = finite_rows(data, [*features, response]).select(*[F.col(c).cast("double").alias(f"f{k}") for k, c in enumerate([*features, response])], *([F.col(row_id).alias("id")] if row_id else []))
    names = [f"f{k}" for k in range(len(features) + 1)]
    ranked = with_ranks(rows, ["id"] if row_id else names, "place")
    p = len(model.coefficients)
    layout, own = Layout(model.bases, p), FAMILIES[model.family]
    ridge = 2 * spec.penalty * np.r_[0.0, np.ones(p - 1)]
    size, out = 1 + p + p * p, [None] * replicates
    group = max(1, REPLICA_NUMBERS // size)
    for first in range(0, replicates, group):
        beta = {r: model.coefficients.copy() for r in range(first, min(first + group, replicates))}
        trial, held = dict(beta), {}
        for _ in range(spec.max_iterations):
            order = sorted(trial)

            def function(x, y, order=order, trial=trial):
                parts, total = layout.parts(x[:, :-1], centred=True), []
                for r in order:
                    often = counts(seed, r, x[:, -1].astype(np.int64))
                    mu, slope, variance = own.working(layout.linear(parts, trial[r]))
                    weight = often * slope**2 / variance
                    total += [[(often * own.deviance(y, mu)).sum()], layout.score(parts, weight * (y - mu) / slope), layout.gram(parts, weight).ravel()]
                return np.concatenate(total)

            sums = _sums(ranked, [*names[:-1], "place"], names[-1], function, size * len(order)).reshape(len(order), size)
            following = {}
            for r, told in zip(order, sums):
                value = told[0] / 2 + (ridge * trial[r] ** 2).sum() / 2
                if r in held and not value <= held[r][0] + 1e-12 * max(1, abs(held[r][0])):
                    held[r][1], held[r][2] = held[r][1] / 2, held[r][2] + 1  # half of the last move
                    if held[r][2] < 20:
                        following[r] = beta[r] + held[r][1]
                    continue
                change = np.abs(trial[r] - beta[r]).max() if r in held else np.inf
                beta[r], score = trial[r], told[1:1 + p] - ridge * trial[r]
                if change <= spec.tolerance * max(1, float(np.abs(beta[r]).max())):
                    out[r] = beta[r]
                    continue
                try:
                    move = np.linalg.solve(told[1 + p:].reshape(p, p) + np.diag(ridge), score)
                except np.linalg.LinAlgError:
                    continue
                if np.isfinite(move).all() and np.isfinite(value):
                    held[r], following[r] = [value, move, 0], beta[r] + move
            trial = following
            if not trial:
                break
    return out
