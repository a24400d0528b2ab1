"""The gaussian additive model: one-dimensional local regressions fitted in turn to partial residuals."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

from .local import Loess


@dataclass
class AdditiveTerm:
    predictor: int
    smoother: Loess
    offset: float

    def predict(self, values, policy="polynomial"):
        return self.smoother.predict(np.asarray(values, float).reshape(-1, 1), policy) - self.offset

    def gradient(self, values):
        return self.smoother.gradient(np.asarray(values, float).reshape(-1, 1))[:, 0]

    @property
    def edf(self) -> float:
        return max(self.smoother.trace - 1, 0)

    def diagnostics(self) -> dict:
        effect = self.predict(self.smoother.x[:, 0])
        return {"predictor": self.predictor, "edf": self.edf, "mean": float(effect.mean()), "rms": float(np.sqrt((effect**2).mean())), "min": float(effect.min()), "max": float(effect.max())}

    def partial_effect(self, count=100, policy="polynomial"):
        low, high = self.smoother.x.min(), self.smoother.x.max()
        if count < 2 or not high > low:
            return None
        x = low + (high - low) * np.arange(count) / (count - 1)
        return pd.DataFrame({"predictor": self.predictor, "x": x, "effect": self.predict(x, policy), "grad": self.gradient(x)})


@dataclass
class AdditiveModel:
    x: np.ndarray
    y: np.ndarray
    intercept: float
    terms: list[AdditiveTerm]
    row_ids: np.ndarray
    fitted: np.ndarray
    sigma: float
    edf: float
    iterations: int
    change: float
    family = "gaussian"

    @classmethod
    def fit(cls, x, y, terms=None, span=0.75, degree=2, robust_iterations=0, max_iterations=100, tolerance=1e-8, row_ids=None):
        """terms: (predictor, span, degree) triples, one per predictor at most. None if invalid or if the rounds do not settle."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        if x.ndim != 2 or not x.size or len(x) != len(y) or not np.isfinite(x).all() or not np.isfinite(y).all() or max_iterations < 1 or not (np.isfinite(tolerance) and tolerance > 0):
            return None
        terms = [(j, span, degree) for j in range(x.shape[1])] if terms is None else list(terms)
        if not terms or len({t[0] for t in terms}) < len(terms) or any(not 0 <= j < x.shape[1] for j, _, _ in terms):
            return None
        centre = float(y.mean())
        effects, own = np.zeros((len(terms), len(y))), [None] * len(terms)
        limit = tolerance * max(1.0, float(np.abs(y - centre).max()))
        for iteration in range(1, max_iterations + 1):
            change = 0.0
            for k, (j, s, d) in enumerate(terms):
                rest = y - centre - effects.sum(axis=0) + effects[k]
                smoother = Loess.fit(x[:, [j]], rest, s, d, robust_iterations)
                if smoother is None:
                    return None
                offset = float(smoother.fitted.mean())
                now = smoother.fitted - offset
                change = max(change, float(np.abs(now - effects[k]).max()))
                effects[k], own[k] = now, AdditiveTerm(j, smoother, offset)
            if change <= limit:
                break
        else:
            return None
        fitted = centre + effects.sum(axis=0)
        edf = 1 + sum(t.edf for t in own)
        sigma = float(np.sqrt(((y - fitted) ** 2).sum() / max(len(y) - edf, 1)))
        return cls(x, y, centre, own, np.arange(len(x)) if row_ids is None else np.asarray(row_ids), fitted, sigma, edf, iteration, change)

    @property
    def trace(self) -> float:
        return self.edf

    def contributions(self, queries, policy="polynomial"):
        queries = np.asarray(queries, float).reshape(-1, self.x.shape[1])
        effects = np.stack([t.predict(queries[:, t.predictor], policy) for t in self.terms], axis=1)
        return np.where(np.isfinite(queries).all(axis=1)[:, None], effects, np.nan)

    def predict(self, queries, policy="polynomial", fast=False):
        return self.intercept + self.contributions(queries, policy).sum(axis=1)

    def gradient(self, queries):
        """Derivatives by each predictor, 0 without a term; a row where a term has none is nan."""
        queries = np.asarray(queries, float).reshape(-1, self.x.shape[1])
        out = np.zeros(queries.shape)
        for t in self.terms:
            out[:, t.predictor] = t.gradient(queries[:, t.predictor])
        return np.where((np.isnan(out).any(axis=1) | ~np.isfinite(queries).all(axis=1))[:, None], np.nan, out)

    def standard_error(self, queries, policy="polynomial", fast=False):
        return None
