"""Numeric kernels against exact cases, optimality conditions and dense solutions."""

import numpy as np
import pytest

from driftglass.functions.folds import permutation, shuffled_folds
from driftglass.functions.numbers import percentile
from driftglass.operators.additive import AdditiveModel
from driftglass.operators.automatic import fit_automatic, select_span
from driftglass.operators.families import FAMILIES, classify
from driftglass.operators.local import AdaptiveLoess, LocalLikelihood, Loess, NadarayaWatson, inside_box
from driftglass.operators.neighbours import nearest
from driftglass.operators.sequence import TotalVariation, Whittaker, banded_factor, banded_inverse_diagonal, banded_solve, difference_row, penalty_bands, select_penalty, total_variation

RANDOM = np.random.default_rng(42)


def column(values):
    return np.asarray(values, float)[:, None]


def sine(n=60, noise=0.1):
    x = np.sort(RANDOM.uniform(0, 6, n))
    return column(x), np.sin(x) + noise * RANDOM.standard_normal(n)


@pytest.mark.parametrize("p", [1, 2, 3, 5])
@pytest.mark.parametrize("n", [1, 40, 150])
def test_neighbours_with_ties(p, n):
    x, q = RANDOM.integers(0, 7, (n, p)) / 2, RANDOM.integers(-1, 9, (25, p)) / 2
    for k in (1, 7, n):
        at, d = nearest(x, q, k)
        for i in range(len(q)):
            d2 = ((x - q[i]) ** 2).sum(axis=1)
            assert at[i].tolist() == np.lexsort((np.arange(n), d2))[:min(max(k, 1), n)].tolist()
            assert np.allclose(d[i], np.sqrt(d2[at[i]]))


def test_exact_reproduction():
    x = column(np.arange(15))
    line = Loess.fit(x, 2 * x[:, 0] - 1, 0.75, 1)
    assert np.allclose(line.fitted, line.y, atol=1e-9) and line.predict([[7.5]])[0] == pytest.approx(14)
    assert np.allclose(line.gradient([[3.3], [20]]), 2)
    x = column(np.arange(20) / 4)
    assert np.allclose(Loess.fit(x, x[:, 0] ** 2, 0.6, 2).fitted, x[:, 0] ** 2, atol=1e-7)
    x = RANDOM.uniform(0, 3, (40, 2))
    plane = Loess.fit(x, 1 + 2 * x[:, 0] - x[:, 1], 0.6, 1)
    assert np.allclose(plane.fitted, plane.y, atol=1e-7) and np.allclose(plane.gradient(x[:5]), [2, -1], atol=1e-6)
    flat = NadarayaWatson.fit(column(np.arange(20)), np.full(20, 3.25))
    assert np.allclose(flat.predict([[5.5], [100]]), 3.25, atol=1e-12)
    adaptive = AdaptiveLoess.fit(column(np.arange(15)), 2 * np.arange(15.0) - 1, 1)
    assert np.allclose(adaptive.fitted, adaptive.y, atol=1e-9)


def test_outlier_is_resisted():
    x, y = column(np.arange(20)), 2.0 * np.arange(20)
    y[10] = 500
    assert abs(Loess.fit(x, y, 0.75, 1).fitted[10] - 20) < 3
    assert abs(AdaptiveLoess.fit(x, y, 1).fitted[10] - 20) < 3


def test_kernel_mean_is_local_regression_of_degree_zero():
    x, y = sine()
    a, b = NadarayaWatson.fit(x, y, 0.4), Loess.fit(x, y, 0.4, 0)
    assert np.allclose(a.fitted, b.fitted) and np.allclose(a.predict(x + 0.01), b.predict(x + 0.01))
    q, h = column(RANDOM.uniform(0.5, 5.5, 12)), 1e-6
    assert np.allclose(a.gradient(q)[:, 0], (a.predict(q + h) - a.predict(q - h)) / (2 * h), atol=1e-4)


def test_recovery_and_selection():
    x, y = sine(80)
    best = select_span(Loess, x, y, (0.3, 0.5, 0.75), degree=2)
    assert 0.05 < best.sigma < 0.2 and np.sqrt(((best.fitted - np.sin(x[:, 0])) ** 2).mean()) < 0.1
    assert np.isfinite(best.standard_error(x)).all() and (best.standard_error(x) > 0).all()


def test_adaptive_neighbourhoods_follow_curvature():
    x = np.linspace(0, 6, 60)
    t = np.maximum(0, x - 3)
    y = 0.5 * t**2 * np.sin(2 * t) + 0.05 * np.random.default_rng(3).standard_normal(60)
    model = AdaptiveLoess.fit(column(x), y, 2)
    assert model.selected[x < 2].mean() > model.selected[x > 4].mean()
    assert AdaptiveLoess.grid(60, 5)[0] == 5 and AdaptiveLoess.grid(60, 5)[-1] == 60 and AdaptiveLoess.grid(3, 5) == []
    duplicated = AdaptiveLoess.fit(column([0, 1, 1, 1, 2, 3]), np.array([0, 1, 2, 3, 4, 5.0]), 0)
    assert np.allclose(duplicated.predict(duplicated.x), duplicated.predict(duplicated.x, fast=True))


def test_policies_and_bad_input():
    x, y = sine(30)
    for model in (Loess.fit(x, y, 0.5, 1), NadarayaWatson.fit(x, y, 0.5), AdaptiveLoess.fit(x, y, 1), LocalLikelihood.fit(x, y, 1, "gaussian", 0.5)):
        outside = [[-5.0], [99.0]]
        assert np.isnan(model.predict(outside, "unavailable")).all() and np.isfinite(model.predict(outside)).all()
        assert np.allclose(model.predict(outside, "nearest"), model.fitted[[0, -1]])
        assert np.isnan(model.predict([[np.nan]], "polynomial"))[0]
        with pytest.raises(ValueError):
            model.predict(outside, "other")
    assert Loess.fit(x, np.where(np.arange(30) == 3, np.nan, y)) is None
    assert Loess.fit(x, y, span=0) is None and Loess.fit(x, y, degree=3) is None and Loess.fit(x[:0], y[:0]) is None
    assert inside_box(x, np.array([x[0], [x[0, 0] - 1]])).tolist() == [True, False]


def test_local_likelihood():
    x = column(np.linspace(-2, 2, 120))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (np.random.default_rng(1).uniform(size=120) < p).astype(float)
    model = LocalLikelihood.fit(x, y, 1, "binomial", 0.75)
    assert np.sqrt(((model.fitted - p) ** 2).mean()) < 0.15 and model.deviance <= model.null_deviance
    step = LocalLikelihood.fit(column(np.linspace(-2, 2, 40)), (np.linspace(-2, 2, 40) > 0).astype(float), 1, "binomial", 0.5)
    assert np.isfinite(step.fitted).all() and step.fitted[0] < 0.05 and step.fitted[-1] > 0.95
    mu = np.exp(0.5 + 0.5 * x[:, 0])
    counts = LocalLikelihood.fit(x, np.random.default_rng(2).poisson(mu).astype(float), 1, "poisson", 0.75)
    assert np.sqrt(((counts.fitted - mu) ** 2).mean()) < 0.8 and counts.deviance < counts.null_deviance
    line = LocalLikelihood.fit(column(np.arange(20)), 100 + 5 * np.arange(20.0), 1, "gaussian", 0.6)
    assert np.allclose(line.fitted, line.y, atol=1e-6) and np.allclose(line.gradient([[4.5]]), 5)
    assert LocalLikelihood.fit(x, y + 0.5, 1, "binomial") is None and LocalLikelihood.fit(x, -y, 1, "poisson") is None


def test_score_of_local_likelihood_vanishes():
    x = column(np.linspace(-2, 2, 50))
    y = (np.random.default_rng(5).uniform(size=50) < 0.5).astype(float)
    model = LocalLikelihood.fit(x, y, 1, "binomial", 0.8)
    at, d = nearest(x, np.array([[0.3]]), model.k)
    w = (1 - (d[0] / d[0].max()) ** 3) ** 3
    beta = model._points(np.array([[0.3]]))[2][0]
    z = x[at[0], 0] - 0.3
    mu = 1 / (1 + np.exp(-(beta[0] + beta[1] * z)))
    assert abs((w * (y[at[0]] - mu)).sum()) < 1e-3 and abs((w * z * (y[at[0]] - mu)).sum()) < 1e-3


def test_banded_solver_against_dense():
    for order in (1, 2, 3):
        n = 25
        d = np.diff(np.eye(n), order, axis=0)
        assert np.allclose(difference_row(order), d[0, :order + 1])
        bands = 3.0 * penalty_bands(n, order)
        bands[0] += 1
        dense = np.eye(n) + 3 * d.T @ d
        factor = banded_factor(bands)
        right = RANDOM.standard_normal((n, 2))
        assert np.allclose(banded_solve(*factor, right), np.linalg.solve(dense, right))
        assert np.allclose(banded_inverse_diagonal(*factor), np.diag(np.linalg.inv(dense)))
    assert banded_factor(np.array([[1.0, 0.0]])) is None


def test_whittaker():
    y = RANDOM.uniform(-2, 2, 30)
    x = column(np.arange(30))
    assert np.allclose(Whittaker.fit(x, y, 0.0).fitted, y)
    s = np.linalg.inv(np.eye(30) + 7 * np.diff(np.eye(30), 2, axis=0).T @ np.diff(np.eye(30), 2, axis=0))
    model = Whittaker.fit(x, y, 7.0, 2)
    assert np.allclose(model.fitted, s @ y) and model.trace == pytest.approx(np.trace(s))
    assert np.allclose(model.errors, model.sigma * np.sqrt((s**2).sum(axis=1)))
    backward = Whittaker.fit(x[::-1], y[::-1], 7.0, 2)
    assert np.allclose(backward.fitted[::-1], model.fitted)
    assert model.predict([4.25])[0] == pytest.approx(0.75 * model.fitted[4] + 0.25 * model.fitted[5])
    assert np.isnan(model.predict([-1.0, 99.0])).all() and model.predict([-1.0], "nearest")[0] == model.fitted[0]
    assert model.gradient([4.25])[0, 0] == pytest.approx(model.fitted[5] - model.fitted[4])
    assert select_penalty(Whittaker, x, np.sin(x[:, 0] / 5), (0.1, 1.0, 10.0)) is not None
    assert Whittaker.fit(x, y, -1.0) is None and Whittaker.fit(x[:2], y[:2], 1.0, 2) is None and Whittaker.fit(x, y, 1.0, 4) is None


@pytest.mark.parametrize("seed", range(12))
def test_total_variation_is_optimal(seed):
    random_ = np.random.default_rng(seed)
    for penalty in (0.0, 0.1, 1.0, 10.0):
        y = np.round(random_.standard_normal(random_.integers(1, 60)) * 3, 1)
        x = total_variation(y, penalty)
        dual, jumps = np.cumsum(y - x)[:-1], np.diff(x)
        assert (np.abs(dual) <= penalty + 1e-8).all() and (y - x).sum() == pytest.approx(0, abs=1e-8)
        moved = np.abs(jumps) > 1e-9
        assert np.allclose(dual[moved], -penalty * np.sign(jumps[moved]), atol=1e-7)


def test_total_variation_steps():
    truth = np.repeat([0.0, 2.0, 1.0], 30)
    y = truth + 0.1 * np.random.default_rng(2).standard_normal(90)
    model = TotalVariation.fit(column(np.arange(90)), y, 0.5)
    assert np.sqrt(((model.fitted - truth) ** 2).mean()) < 0.15 and model.trace < 12
    assert model.predict([10.5])[0] == model.fitted[10] and model.gradient([10.5])[0, 0] == 0 and (model.errors == model.sigma).all()


def test_additive_model():
    a, b = (v.ravel() for v in np.meshgrid(np.linspace(0, 3, 13), np.linspace(-1, 1, 11)))
    model = AdditiveModel.fit(np.stack([a, b], axis=1), 2.5 + np.sin(a) + 0.45 * b**2, span=0.5)
    assert model is not None and np.sqrt(((model.fitted - model.y) ** 2).mean()) < 0.04 and model.iterations <= 12
    assert all(abs(t.smoother.fitted.mean() - t.offset) < 1e-9 for t in model.terms)
    a, b = (v.ravel() for v in np.meshgrid(np.arange(6.0), np.arange(6.0)))
    plane = AdditiveModel.fit(np.stack([a, b], axis=1), 1 + 2 * a - 3 * b, degree=1)
    assert np.allclose(plane.predict(plane.x), plane.y, atol=1e-6) and np.allclose(plane.gradient(plane.x[:3]), [2, -3], atol=1e-6)
    assert AdditiveModel.fit(plane.x, plane.y, [(0, 0.5, 1), (0, 0.5, 1)]) is None and np.isnan(plane.predict([[np.nan, 0]]))[0]
    assert len(plane.terms[0].partial_effect(10)) == 10


def test_automatic_choice():
    x, y = sine(40)
    fit, told = fit_automatic(x, y, robust_iterations=1)
    assert told.smoother in ("AdaptiveLoess", "Loess") and told.score == pytest.approx(fit.gcv())
    assert fit_automatic(x, (y > 0).astype(float))[1].smoother == "LocalLikelihood"
    assert fit_automatic(x, np.round(np.exp(y)))[0].family == "poisson"
    tiny = fit_automatic(column([0, 1, 2]), np.array([0, 1.5, 4]))
    assert tiny is not None and tiny[1].smoother == "Loess" and tiny[1].notes
    assert classify(np.array([0, 1.0])) == "binomial" and classify(np.array([0, 2.0])) == "poisson" and classify(np.array([0.5])) == "gaussian"


def test_folds_and_percentiles():
    assert permutation(10, 42) == [2, 1, 0, 6, 7, 5, 4, 9, 8, 3]
    assert permutation(10) == [2, 6, 0, 3, 9, 5, 4, 7, 8, 1]
    dealt = shuffled_folds(40, 4, 1)
    assert [dealt.count(f) for f in range(4)] == [10] * 4 and dealt != sorted(dealt)
    assert percentile([3.0, 1.0, 2.0], 0.25) == 1.5 and percentile([], 0.5) is None


def test_deviances_are_not_negative():
    for name, family in FAMILIES.items():
        y = np.array([0.0, 1.0, 1.0, 0.0])
        assert (family.deviance(y, np.array([0.0, 1.0, 0.3, 0.7])) >= 0).all(), name


@pytest.mark.parametrize("width", [2, 3, 5])
def test_neighbours_by_boxes_equal_all_distances(width):
    from driftglass.operators.neighbours import _nearest_all, _nearest_boxes, boxes

    random_ = np.random.default_rng(width)
    for train in (random_.integers(0, 12, (900, width)) / 2.0, random_.standard_normal((900, width)), np.repeat(random_.standard_normal((3, width)), 300, axis=0)):
        queries = np.concatenate([train[::7], random_.standard_normal((40, width)) * 5])
        for k in (1, 5, 60):
            for one, two in zip(_nearest_all(train, queries, k), _nearest_boxes(train, queries, k)):
                assert (one == two).all()
    groups = boxes(random_.standard_normal((1000, width)), 50)
    assert max(map(len, groups)) <= 50 and sorted(np.concatenate(groups).tolist()) == list(range(1000))


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("penalty", [0.5, 100.0, 1e7])
def test_row_lengths_equal_the_dense_inverse(order, penalty):
    from driftglass.operators.sequence import banded_square, penalty_bands, whittaker_system

    for n in (order + 1, 7, 40):
        d = np.diff(np.eye(n), order, axis=0)
        a = np.eye(n) + penalty * d.T @ d
        bands = penalty * penalty_bands(n, order)
        bands[0] += 1
        squared = banded_square(bands)
        for b in range(min(2 * order + 1, n)):
            assert np.allclose(squared[b, :n - b], np.diagonal(a @ a, b))
        inverse = np.linalg.inv(a)
        for exact, close in ((0, 1e-6), (100, 1e-6 if penalty > 1e6 else 1e-11)):
            _, trace, lengths = whittaker_system(n, penalty, order, True, exact)
            assert np.allclose(lengths, np.linalg.norm(inverse, axis=1), rtol=close) and abs(trace - np.trace(inverse)) < 1e-6 * n


def test_draws_and_counts():
    from driftglass.functions.generators import _mixed, counts, draws, splitmix64

    seed = int(_mixed(np.array([5 + 3], dtype=np.uint64))[0])
    stream = splitmix64(seed)
    assert draws(5, 3, 7).tolist() == [next(stream) % 7 for _ in range(7)]
    many = counts(9, 1, np.arange(200_000))
    assert abs(many.mean() - 1) < 0.01 and abs(many.var() - 1) < 0.02 and abs((many == 0).mean() - np.exp(-1)) < 0.005


def test_conjugate_gradients_equal_elimination():
    from driftglass.operators.glm import conjugate_gradients

    random_ = np.random.default_rng(1)
    d = random_.standard_normal((200, 30)) * random_.uniform(0.01, 10, 30)
    a, b = d.T @ d + np.eye(30), random_.standard_normal(30)
    x, told = conjugate_gradients(a, b)
    assert np.allclose(x, np.linalg.solve(a, b), rtol=1e-8) and told["solver_converged"] and 0 < told["solver_iterations"] <= told["solver_limit"]
    assert not conjugate_gradients(a, b, limit=2)[1]["solver_converged"]


def test_generators():
    from driftglass.functions.generators import Xoshiro256, splitmix64

    assert next(splitmix64(0)) == 0xE220A8397B1DCDAF
    assert Xoshiro256((1, 2, 3, 4)).word() == 11520
    g = Xoshiro256(7)
    values = [g.normal() for _ in range(4000)]
    assert abs(np.mean(values)) < 0.08 and abs(np.std(values) - 1) < 0.05
    assert {Xoshiro256(s).below(3) for s in range(40)} == {0, 1, 2} and 0 <= g.uniform() < 1
