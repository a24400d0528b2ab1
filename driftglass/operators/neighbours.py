"""Nearest training rows of query points, and the local weights and designs built on them (vectorised)."""

from __future__ import annotations

import numpy as np


def tricube(u: np.ndarray) -> np.ndarray:
    """(1 - u^3)^3 on [0, 1), 0 elsewhere."""
    return np.where((u >= 0) & (u < 1), (1 - u**3) ** 3, 0.0)


def bisquare(u: np.ndarray) -> np.ndarray:
    """(1 - u^2)^2 on [0, 1), 0 elsewhere."""
    return np.where((u >= 0) & (u < 1), (1 - u**2) ** 2, 0.0)


def nearest(train: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, distances) of the k nearest rows of train, nearest first, ties to the smaller index; k is kept within 1..n.

    One dimension: a window of the sorted values holds every candidate. More: rows and queries are cut into boxes, and only boxes that may hold
    a neighbour are looked at.
    """
    n = len(train)
    k = min(max(k, 1), n)
    if train.shape[1] == 1 and n > 64:
        return _nearest_sorted(train[:, 0], queries[:, 0], k)
    if n > 512 and 4 * k < n and np.isfinite(queries).all():
        return _nearest_boxes(train, queries, k)
    return _nearest_all(train, queries, k)


def _nearest_all(train: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(train)
    if len(queries) * train.size > 8_000_000 and len(queries) > 1:
        parts = [_nearest_all(train, queries[s], k) for s in blocks(len(queries), train.size)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    d2 = ((queries[:, None, :] - train[None, :, :]) ** 2).sum(axis=2)
    if k < n // 4:
        kth = np.partition(d2, k - 1, axis=1)[:, k - 1:k]
        d2 = np.where(d2 <= kth, d2, np.inf)
    at = np.argsort(d2, axis=1, kind="stable")[:, :k]
    return at, np.sqrt(np.take_along_axis(d2, at, axis=1))


def boxes(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows in groups of at most `size`, cut at medians of the widest coordinate; rows of a group are in order."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        own = points[rows]
        width = np.ptp(own, axis=0) if len(rows) else np.zeros(1)
        if len(rows) <= size or not width.max() > 0:
            done.append(np.sort(rows))
            continue
        order = np.argsort(own[:, int(width.argmax())], kind="stable")
        todo += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
    return done


def _nearest_boxes(train: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each box of queries: the farthest that its kth neighbours can be, by the boxes that surely hold k rows, says which boxes are looked at."""
    leaves = boxes(train, max(32, k // 2))
    low, high = (np.array([f(train[rows], axis=0) for rows in leaves]) for f in (np.min, np.max))
    sizes = np.array([len(rows) for rows in leaves])
    at, d = np.empty((len(queries), k), dtype=np.int64), np.empty((len(queries), k))
    for own in boxes(queries, 256):
        if not len(own):
            continue
        first, last = queries[own].min(axis=0), queries[own].max(axis=0)
        nearest_2 = (np.maximum(0, np.maximum(low - last, first - high)) ** 2).sum(axis=1)
        farthest_2 = (np.maximum(np.abs(high - first), np.abs(last - low)) ** 2).sum(axis=1)
        order = np.argsort(farthest_2, kind="stable")
        reach = farthest_2[order[int(np.searchsorted(np.cumsum(sizes[order]), k))]]
        near = np.flatnonzero(nearest_2 <= reach * (1 + 1e-9))
        rows = np.sort(np.concatenate([leaves[i] for i in near]))
        own_at, own_d = _nearest_all(train[rows], queries[own], k)
        at[own], d[own] = rows[own_at], own_d
    return at, d


def _nearest_sorted(train: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(train, kind="stable")
    x = train[order]
    n = len(x)
    # The window of k sorted values that starts at s is the nearest one if x[s + k] is not nearer than x[s].
    low = np.zeros(len(queries), dtype=np.int64)
    high = np.full(len(queries), n - k, dtype=np.int64)
    while (low < high).any():
        middle = (low + high) // 2
        right = np.minimum(middle + k, n - 1)
        move = (queries - x[middle] > x[right] - queries) & (low < high)
        low = np.where(move, middle + 1, low)
        high = np.where(move | (low >= high), high, middle)
    radius = np.maximum(np.abs(queries - x[low]), np.abs(x[low + k - 1] - queries))
    first = np.minimum(low, np.searchsorted(x, queries - radius, side="left"))
    last = np.maximum(low + k, np.searchsorted(x, queries + radius, side="right"))
    wide = int((last - first).max())  # over k only where distances tie
    window = first[:, None] + np.arange(wide)[None, :]
    real = window < last[:, None]
    rows = order[np.minimum(window, n - 1)]
    d = np.where(real, np.abs(train[rows] - queries[:, None]), np.inf)
    pick = np.lexsort((rows, d), axis=1)[:, :k]
    return np.take_along_axis(rows, pick, axis=1), np.take_along_axis(d, pick, axis=1)


def blocks(n_queries: int, width: int, limit: int = 4_000_000):
    """Slices of the queries whose (queries x width) arrays stay within `limit` numbers."""
    step = max(1, limit // max(1, width))
    for s in range(0, n_queries, step):
        yield slice(s, min(s + step, n_queries))


def basis_size(degree: int, p: int) -> int:
    return 1 + (p if degree >= 1 else 0) + (p * (p + 1) // 2 if degree >= 2 else 0)


def basis(diff: np.ndarray, degree: int) -> np.ndarray:
    """Monomials up to `degree` of centred coordinates (..., p): 1, each, then products i <= j."""
    parts = [np.ones(diff.shape[:-1])]
    p = diff.shape[-1]
    if degree >= 1:
        parts += [diff[..., i] for i in range(p)]
    if degree >= 2:
        parts += [diff[..., i] * diff[..., j] for i in range(p) for j in range(i, p)]
    return np.stack(parts, axis=-1)


def neighbour_count(n: int, span: float, least: int) -> int:
    return min(n, max(int(np.ceil(span * n)), least))


def locality(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tricube weights, bandwidths): the bandwidth is the largest distance; where it is 0 all weights are 1."""
    h = distances.max(axis=1)
    return np.where(h[:, None] > 0, tricube(distances / np.where(h > 0, h, 1)[:, None]), 1.0), h


def solve_local(design: np.ndarray, weights: np.ndarray, y: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted least squares of many small problems: (ok, coefficients or None, equivalent kernel of the first coefficient).

    design (m, k, q), weights (m, k), y (m, k). A problem with fewer weighted rows than columns or a QR diagonal not
    above 1e-12 of its first element (or of 1) is not ok.
    """
    root = np.sqrt(weights)
    m, k, q = design.shape
    if k < q:
        return np.zeros(m, bool), np.zeros((m, q)), np.zeros((m, k))
    a, r = np.linalg.qr(design * root[..., None])
    diagonal = np.abs(np.diagonal(r, axis1=1, axis2=2))
    ok = (diagonal > 1e-12 * np.maximum(diagonal[:, :1], 1)).all(axis=1) & ((weights > 0).sum(axis=1) >= q)
    safe = np.where(ok[:, None, None], r, np.eye(q))
    hat = np.linalg.solve(safe, np.swapaxes(a, 1, 2)) * root[:, None, :]  # (m, q, k)
    beta = np.einsum("mqk,mk->mq", hat, y) if y is not None else np.zeros((m, q))
    return ok, beta, hat[:, 0, :]
