"""Small numeric helpers on the driver."""

from __future__ import annotations

from statistics import NormalDist


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def percentile(values: list[float], p: float) -> float | None:
    """Linear interpolation at place p (n - 1) of the sorted values; None for no values or p outside 0..1."""
    if not values or not 0 <= p <= 1:
        return None
    ordered = sorted(values)
    place = p * (len(ordered) - 1)
    low = int(place)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (place - low) * (ordered[high] - ordered[low])
