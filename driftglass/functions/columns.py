"""Column expressions: kernels, links, deviances, residuals. All run inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-15  # how near means may come to 0 and 1 in losses and residuals


def _double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def tricube(u: Column | str) -> Column:
    u = _double(u)
    t = 1.0 - u * u * u
    return F.when((u >= 0) & (u < 1), t * t * t).otherwise(0.0)


def bisquare(u: Column | str) -> Column:
    u = _double(u)
    t = 1.0 - u * u
    return F.when((u >= 0) & (u < 1), t * t).otherwise(0.0)


def link_mean(eta: Column | str, family: str) -> Column:
    """Mean of a link, kept within 30 of 0 where it is exponentiated."""
    e = _double(eta)
    bounded = F.least(F.greatest(e, F.lit(-30.0)), F.lit(30.0))
    return {"gaussian": e, "binomial": 1.0 / (1.0 + F.exp(-bounded)), "poisson": F.exp(bounded)}[family]


def _mean(mu: Column, family: str, epsilon: float) -> Column:
    low = F.greatest(mu, F.lit(epsilon))
    return F.least(low, F.lit(1 - epsilon)) if family == "binomial" else low


def deviance(y: Column | str, mu: Column | str, family: str, epsilon: float = EPSILON) -> Column:
    """Unit deviance, 0 log 0 being 0."""
    y, mu = _double(y), _double(mu)
    if family == "gaussian":
        return (y - mu) * (y - mu)
    m = _mean(mu, family, epsilon)
    gain = F.when(y == 0, 0.0).otherwise(y * F.log(y / m))
    if family == "poisson":
        return F.when(y == 0, 2 * m).otherwise(2 * (gain - (y - m)))
    return 2 * (gain + F.when(y == 1, 0.0).otherwise((1 - y) * F.log((1 - y) / (1 - m))))


def loss(observed: Column | str, predicted: Column | str, family: str) -> Column:
    """What validation compares: squared error or unit deviance."""
    return deviance(observed, predicted, family)


def residual(y: Column | str, mu: Column | str, kind: str, family: str, sigma: Column | float = 1.0) -> Column:
    """raw, pearson or deviance residuals; pearson ones of a perfect gaussian fit are 0 for no error, else NaN."""
    y, mu = _double(y), _double(mu)
    raw = y - mu
    if kind == "raw" or (kind == "deviance" and family == "gaussian"):
        return raw
    if kind == "deviance":
        return F.signum(raw) * F.sqrt(F.greatest(deviance(y, mu, family), F.lit(0.0)))
    if family == "gaussian":
        s = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
        return F.when(s > 0, raw / F.when(s > 0, s)).when(raw == 0, 0.0).otherwise(float("nan"))
    m = _mean(mu, family, EPSILON)
    return raw / F.sqrt(m * (1 - m) if family == "binomial" else m)


def soft_threshold(x: Column | str, by: Column | float) -> Column:
    x = _double(x)
    return F.signum(x) * F.greatest(F.abs(x) - by, F.lit(0.0))


def median_of(column: Column | str) -> Column:
    """Exact median: the mean of the middle two."""
    return F.percentile(_double(column), F.lit(0.5))


def quadratic_form(row: Column, matrix: list[list[float]]) -> Column:
    """row' M row for an array column, 0 at least."""
    parts = [F.aggregate(F.zip_with(row, F.array(*[F.lit(float(v)) for v in line]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for line in matrix]
    return F.greatest(F.aggregate(F.zip_with(row, F.array(*parts), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v), F.lit(0.0))
