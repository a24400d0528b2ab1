"""Response families: link, working quantities, unit deviances, starting values."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bounds (fixed values): of the link in weights, of means in logarithms, of mean starts.
ETA_BOUND, MEAN_BOUND, START_BOUND = 30.0, 1e-12, 1e-6


@dataclass(frozen=True)
class Family:
    name: str
    link: str

    def allows(self, y: np.ndarray) -> bool:
        if self.name == "binomial":
            return bool(np.isin(y, (0.0, 1.0)).all())
        return self.name == "gaussian" or bool((y >= 0).all())

    def mean(self, eta):
        eta = np.asarray(eta, float)
        if self.name == "binomial":
            e = np.exp(-np.abs(eta))
            return np.where(eta >= 0, 1 / (1 + e), e / (1 + e))
        with np.errstate(over="ignore"):
            return eta if self.name == "gaussian" else np.exp(eta)

    def working(self, eta):
        """(mean, its slope, variance) at links kept within the bound (gaussian links have none)."""
        if self.name == "gaussian":
            return np.asarray(eta, float), np.ones_like(eta, dtype=float), np.ones_like(eta, dtype=float)
        mu = self.mean(np.clip(eta, -ETA_BOUND, ETA_BOUND))
        if self.name == "binomial":
            mu = np.clip(mu, MEAN_BOUND, 1 - MEAN_BOUND)
            return mu, mu * (1 - mu), mu * (1 - mu)
        mu = np.maximum(mu, MEAN_BOUND)
        return mu, mu, mu

    def deviance(self, y, mu, bound: float = MEAN_BOUND):
        """Unit deviances, 0 log 0 being 0."""
        y, mu = np.asarray(y, float), np.asarray(mu, float)
        if self.name == "gaussian":
            return (y - mu) ** 2
        if self.name == "binomial":
            mu = np.clip(mu, bound, 1 - bound)
            return 2 * (_xlog(y, y / mu) + _xlog(1 - y, (1 - y) / (1 - mu)))
        safe = np.maximum(mu, bound)
        return np.where(y == 0, 2 * mu, 2 * (_xlog(y, y / safe) - (y - safe)))

    def start(self, mean: float) -> float:
        if self.name == "poisson":
            return float(np.log(max(mean, 0.1)))
        return float(self.fallback(mean))

    def fallback(self, mean):
        if self.name == "gaussian":
            return np.asarray(mean, float)
        if self.name == "binomial":
            m = np.clip(mean, START_BOUND, 1 - START_BOUND)
            return np.log(m / (1 - m))
        return np.log(np.maximum(mean, START_BOUND))

    def bounded_mean(self, mean: float) -> float:
        if self.name == "binomial":
            return float(np.clip(mean, START_BOUND, 1 - START_BOUND))
        return max(mean, START_BOUND) if self.name == "poisson" else mean

    def variance(self, mu, bound: float = MEAN_BOUND):
        if self.name == "gaussian":
            return np.ones_like(mu)
        mu = np.clip(mu, bound, 1 - bound) if self.name == "binomial" else np.maximum(mu, bound)
        return mu * (1 - mu) if self.name == "binomial" else mu


def _xlog(a, b):
    return np.where(a > 0, a * np.log(np.where(a > 0, b, 1.0)), 0.0)


FAMILIES = {"gaussian": Family("gaussian", "identity"), "binomial": Family("binomial", "logit"), "poisson": Family("poisson", "log")}


def classify(y: np.ndarray) -> str:
    """binomial for responses of 0 and 1 alone, poisson for whole numbers from 0, else gaussian."""
    if np.isin(y, (0.0, 1.0)).all():
        return "binomial"
    return "poisson" if bool(((y >= 0) & (y == np.floor(y))).all()) else "gaussian"
