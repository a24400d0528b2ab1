"""Choose a smoother by the kind of response and tune it."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .families import classify
from .local import AdaptiveLoess, LocalLikelihood, Loess, NadarayaWatson, whole

SPANS = (0.3, 0.5, 0.75)


@dataclass
class Tuning:
    """What was chosen and why."""

    smoother: str
    detail: str
    score: float
    reason: str
    notes: list[str] = field(default_factory=list)


def select_span(kind, x, y, spans, **options):
    """The fit of the smallest score over spans, the first of equal ones: GCV, or AIC for likelihood fits; None if none fits."""
    fits = [f for f in (kind.fit(x, y, span=s, **options) for s in spans) if f is not None]
    score = (lambda f: f.aic()) if kind is LocalLikelihood else (lambda f: f.gcv())
    fits = [f for f in fits if np.isfinite(score(f))]
    return min(fits, key=score, default=None)


def fit_automatic(x, y, degree=2, spans=SPANS, robust_iterations=4, adaptive=True, row_ids=None, each=whole):
    """(fit, Tuning) or None.

    Responses of 0 and 1 go to binomial, other whole numbers from 0 to Poisson local likelihood with the span of the
    smallest AIC. The rest (or what those cannot fit) goes to adaptive LOESS, unless a fixed span has a smaller GCV.
    """
    y = np.asarray(y, float)
    if degree not in (0, 1, 2) or not len(y):
        return None
    notes: list[str] = []
    kind = classify(y)
    if kind != "gaussian":
        found = select_span(LocalLikelihood, x, y, spans, degree=degree, family=kind, row_ids=row_ids, each=each)
        if found is not None:
            return found, Tuning("LocalLikelihood", f"{kind}, span {found.span}", found.aic(), f"{kind} responses: local likelihood, span by AIC", notes)
        notes.append(f"the {kind} fit failed; continuous smoothers instead")
    best = None
    if adaptive:
        best = AdaptiveLoess.fit(x, y, degree, robust_iterations=robust_iterations, row_ids=row_ids, each=each)
        if best is None:
            notes.append("no neighbourhood is large enough for the adaptive fit; fixed spans only")
    else:
        notes.append("adaptive fit left out; fixed spans only")
    fixed = select_span(Loess, x, y, spans, degree=degree, robust_iterations=robust_iterations, row_ids=row_ids, each=each)
    if fixed is not None and (best is None or fixed.gcv() < best.gcv()):
        best = fixed
    if best is None:
        return None
    if isinstance(best, AdaptiveLoess):
        return best, Tuning("AdaptiveLoess", "neighbourhoods by corrected AIC", best.gcv(), "smaller GCV than any fixed span", notes)
    return best, Tuning("Loess", f"span {best.span}", best.gcv(), "smallest GCV", notes)


__all__ = ["SPANS", "NadarayaWatson", "Tuning", "fit_automatic", "select_span"]
