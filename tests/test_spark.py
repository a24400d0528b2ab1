"""Operators on DataFrames: binding, likelihood models, validation, contours, streams, and the SQL of the catalogue."""

import os
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from driftglass.functions import columns
from driftglass.functions.generators import counts
from driftglass.operators.families import FAMILIES
from driftglass.operators.glm import Category, GlmSpec, Spline, Tensor, fit_glm, fit_replicas, sparse_choice
from driftglass.operators.local import Loess
from driftglass.operators.sequence import Whittaker
from driftglass.plans import contours, validation
from driftglass.plans.grouped import fit_groups
from driftglass.plans.model import ModelSpec, evaluate, fit
from driftglass.sources import binding
from driftglass.streaming import transform_stream

DATA = "/root/testdata/sf0.001"


def frame(spark, **values):
    return spark.createDataFrame(pd.DataFrame(values))


def test_finite_rows_and_families(spark):
    table = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (4, float("inf")), (5, float("-inf")), (6, 0.0)], "row_id int, y double")
    assert [r.row_id for r in binding.finite_rows(table, ["y"]).collect()] == [1, 6]
    assert binding.response_family(table, "y") == "binomial"
    assert binding.training_arrays(table, ["y"], "y") is None and len(binding.training_arrays(table, ["y"], "y", drop_missing=True)[1]) == 2
    with pytest.raises(ValueError):
        binding.training_arrays(table, ["y"], "y", drop_missing=True, most_rows=1)
    assert [r.inside for r in table.select(binding.in_box(["y"], [(0.0, 1.0)]).alias("inside")).collect()] == [True, True, True, False, False, True]  # null and NaN are beyond nothing


def test_automatic_fit_on_rows_with_gaps(spark):
    x = np.linspace(0, 6, 50)
    y = np.sin(x)
    y[::13] = np.nan
    table = frame(spark, row_id=np.arange(50), x=x, y=y)
    model = fit(table, ["x"], "y", ModelSpec(degree=1, spans=(0.3,), adaptive=False), "row_id")
    assert set(model.model.row_ids) == set(np.flatnonzero(np.isfinite(y)))
    one, many = (model.transform(table.repartition(n), errors=True, gradients=True).orderBy("row_id").toPandas() for n in (1, 5))
    assert np.array_equal(one["fit"], many["fit"]) and np.allclose(one["fit"], model.predict(x[:, None]))
    assert model.diagnostics()["n"] == 46 and one["grad"].notna().all()
    assert fit(table, ["x"], "y", ModelSpec(strategy="other")) is None


def test_clashing_columns_pass_through(spark):
    model = Loess.fit(np.arange(10.0)[:, None], np.arange(10.0), 0.8, 1)
    table = spark.createDataFrame([(1.5, "kept"), (None, "null"), (float("nan"), "nan")], "x double, __x0 string")
    got = {r["__x0"]: r.fit for r in evaluate(model, ["x"], table).collect()}
    assert got["kept"] == pytest.approx(1.5) and all(got[k] is None or np.isnan(got[k]) for k in ("null", "nan"))
    assert evaluate(model, ["x"], table.limit(0)).count() == 0


def dense(x, y, penalty):
    """The same minimiser of a gaussian category model by normal equations."""
    levels = [np.unique(c)[1:] for c in x.T]
    d = np.concatenate([np.ones((len(x), 1)), *[(c[:, None] == l[None, :]).astype(float) for c, l in zip(x.T, levels)]], axis=1)
    return np.linalg.solve(d.T @ d + 2 * penalty * np.diag(np.r_[0.0, np.ones(d.shape[1] - 1)]), d.T @ y)


def test_category_model_equals_normal_equations(spark):
    i = np.arange(512)
    x = np.stack([i % 8, i // 8 % 8, i // 64], axis=1).astype(float)
    y = x @ [0.5, -1.0, 2.0] + np.sin(i)
    table = frame(spark, a=x[:, 0], b=x[:, 1], c=x[:, 2], y=y).repartition(4)
    result = fit_glm(table, ["a", "b", "c"], "y", "gaussian", GlmSpec(terms=(Category(0), Category(1), Category(2)), penalty=0.3))
    assert result.converged and np.allclose(result.model.coefficients, dense(x, y, 0.3), atol=1e-6)
    assert np.isnan(result.model.predict([[99.0, 1, 1]]))[0] and 1 <= result.model.edf <= 22
    assert fit_glm(table.withColumn("a", F.col("a") + 0.5), ["a"], "y", "gaussian", GlmSpec(terms=(Category(0),))).status == "invalidInput"


@pytest.mark.parametrize("family", ["gaussian", "binomial", "poisson"])
def test_likelihood_model_score_and_inference(spark, family):
    random_ = np.random.default_rng(4)
    x = random_.uniform(-2, 2, (300, 2))
    eta = 0.3 + x[:, 0] - 0.5 * x[:, 1] ** 2
    y = {"gaussian": eta + 0.1 * random_.standard_normal(300), "binomial": (random_.uniform(size=300) < 1 / (1 + np.exp(-eta))) * 1.0, "poisson": random_.poisson(np.exp(eta)) * 1.0}[family]
    table = frame(spark, a=x[:, 0], b=x[:, 1], y=y)
    result = fit_glm(table, ["a", "b"], "y", family, GlmSpec(penalty=0.1))
    m = result.model
    assert result.converged and m.deviance < m.null_deviance and 1 < m.edf <= len(m.coefficients)
    d = m.design(x)
    slope = d.T @ (y - m.predict(x))
    assert np.abs(slope - 2 * 0.1 * np.r_[0.0, m.coefficients[1:]]).max() < 1e-4 * max(1, np.abs(d.T @ (y - y.mean())).max())
    h = 1e-6
    g = m.gradient(x[:5])
    for j in range(2):
        e = np.eye(2)[j] * h
        assert np.allclose(g[:, j], (m.predict(x[:5] + e) - m.predict(x[:5] - e)) / (2 * h), atol=1e-5)
    low, high = m.interval(x[:5])
    assert (low < m.predict(x[:5])).all() and (m.predict(x[:5]) < high).all()
    assert np.allclose(m.contributions(x).sum(axis=1) + m.coefficients[0], m.linear_predictor(x))
    assert {"effect", "lo", "hi"} <= set(m.partial_effect(0, 20, 0.9).columns)
    wrong = {"binomial": 2.0, "poisson": -1.0}.get(family)
    if wrong is not None:
        assert fit_glm(table.withColumn("y", F.lit(wrong)), ["a"], "y", family).status == "invalidInput"


def test_tensor_surface_and_contours(spark):
    a, b = (v.ravel() for v in np.meshgrid(np.linspace(0, 1, 9), np.linspace(0, 1, 9)))
    y = 1 + 0.7 * a - 0.4 * b + 1.2 * a * b
    model = fit(frame(spark, a=a, b=b, y=y), ["a", "b"], "y", ModelSpec("multivariateGaussian", glm=GlmSpec(terms=(), spatial=Tensor(0, 1), penalty=1e-7)))
    assert np.allclose(model.predict(np.stack([a, b], axis=1)), y, atol=1e-4)
    surface = model.contour(0, 1, [0, 0], 21, 19)
    assert len(surface) == 21 * 19 and model.contour(0, 0, [0, 0]) is None
    lines = contours.segments(spark.createDataFrame(surface), [1.5]).toPandas()
    assert len(lines) and np.allclose(1 + 0.7 * lines.x0 - 0.4 * lines.y0 + 1.2 * lines.x0 * lines.y0, 1.5, atol=0.01)
    saddle = spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0), (0, 1, 1.0, 0.0, -1.0), (1, 0, 0.0, 1.0, -1.0), (1, 1, 1.0, 1.0, 1.0)], "yi int, xi int, x double, y double, value double")
    assert contours.segments(saddle, [0.0, float("nan")]).count() == 2
    assert contours.segments(saddle.withColumn("value", F.when(F.col("xi") == 0, float("nan")).otherwise(F.col("value"))), [0.0]).count() == 0


def test_specifications(spark):
    spec = ModelSpec("multivariatePoisson", spans=(0.3, 0.5), additive=((0, 0.5, 1),), glm=GlmSpec(terms=(Spline(0), Category(1, (1, 2), 2)), spatial=Tensor(0, 1), temporal=Spline(2, 1)))
    assert ModelSpec.from_json(spec.to_json()) == spec
    assert ModelSpec.from_json('{"strategy": "additiveGaussian"}') == ModelSpec("additiveGaussian")
    assert GlmSpec(terms=(), spatial=Tensor(0, 1)).resolve(2) == [Spline(0, 1), Spline(1, 1), Tensor(0, 1)]
    assert GlmSpec(terms=()).resolve(2) is None and GlmSpec(terms=(Spline(5),)).resolve(2) is None and GlmSpec(penalty=0).resolve(1) is None
    assert sparse_choice(12_000, 253, 5 / 253) and not sparse_choice(100, 253, 0.01) and not sparse_choice(12_000, 253, 0.01, "denseQR")


def test_validation_calibration_comparison(spark):
    random_ = np.random.default_rng(7)
    x = random_.uniform(-2, 2, 140)
    y = (random_.uniform(size=140) < 1 / (1 + np.exp(-x))) * 1.0
    table = frame(spark, row_id=np.arange(140), x=x, y=y)
    quick = ModelSpec(degree=1, spans=(0.75,))
    one = validation.cross_validate(table, ["x"], "y", quick, folds=4, partitioning="stratified")
    two = validation.cross_validate(table, ["x"], "y", ModelSpec("additiveBinomial"), folds=4, partitioning="stratified")
    assert one.family == two.family == "binomial" and one.n == 140 and one.primary > 0
    told = validation.compare(one, two)
    assert told.status == "comparable" and told.summary["candidate_wins"] + told.summary["baseline_wins"] + told.summary["ties"] == 140
    other = validation.cross_validate(table, ["x"], "y", quick, folds=4, partitioning="stratified", seed=1)
    assert validation.compare(one, other).status == "foldAssignmentMismatch"
    assert validation.compare(one, validation.Validation("gaussian", quick, one.predictions, one.folds, {}, 140)).status == "responseFamilyMismatch"
    assert validation.compare(one, validation.Validation("binomial", quick, one.predictions.limit(10), one.folds, {}, 140)).status == "heldOutObservationsMismatch"
    bins, summary = validation.calibration(one.predictions, 10)
    assert bins.count() == 10 and 0 <= summary["ece"] <= 1 and summary["n"] == 140
    assert validation.calibration(one.predictions.withColumn("predicted", F.lit(2.0))) is None
    assert validation.cross_validate(table, ["x"], "y", quick, folds=1) is None
    line = frame(spark, row_id=np.arange(20), x=np.arange(20.0), y=0.5 * np.arange(20) + 0.1)
    blocked = validation.cross_validate(line, ["x"], "y", ModelSpec(degree=1, spans=(0.75,), adaptive=False), folds=4, partitioning="blocked")
    assert [r.id for r in blocked.predictions.filter("fold = 0").orderBy("id").collect()] == [0, 1, 2, 3, 4]
    assert validation.cross_validate(line, ["x"], "y", quick, partitioning="stratified") is None


def test_bootstrap(spark):
    i = np.arange(30)
    table = frame(spark, x=i * 1.0, y=0.5 + 1.25 * i + 0.08 * (i % 3 - 1))
    spec = ModelSpec("additiveGaussian", additive=((0, 0.9, 1),))
    a, b = (validation.bootstrap(table, ["x"], "y", [[3.0], [20.0]], spec, replicates=8, least_success=0.5).predictions.orderBy("id").collect() for _ in range(2))
    assert len(a) == 2 and all(r.lo <= r.hi for r in a)  # sums may be taken in another order, no more
    assert all(r[c] == pytest.approx(t[c], rel=1e-12) for r, t in zip(a, b) for c in ("reference", "mean", "sd", "lo", "hi"))
    assert validation.bootstrap(table, ["x"], "y", [[1.0, 2.0]], spec).status == "invalidInput"


@pytest.mark.parametrize("family", ["gaussian", "poisson"])
def test_replicas_equal_weighted_fits(spark, family):
    """All replicas in one go against single fits of the weighted rows, and their spread against the model's errors."""
    random_ = np.random.default_rng(8)
    x = random_.uniform(0, 1, 400)
    y = 2 * x + 0.3 * random_.standard_normal(400) if family == "gaussian" else random_.poisson(np.exp(1 + x)) * 1.0
    table = frame(spark, row_id=np.arange(400), x=x, y=y).repartition(3)
    spec = GlmSpec(terms=(Spline(0, 0),), penalty=0.05)
    model = fit_glm(table, ["x"], "y", family, spec).model
    found = fit_replicas(table, ["x"], "y", model, spec, 60, 11, "row_id")
    d = model.design(x[:, None])
    for r in (0, 7, 59):
        w, beta = counts(11, r, np.arange(400)), model.coefficients.copy()
        for _ in range(30):
            mu, slope, variance = FAMILIES[family].working(d @ beta)
            v = w * slope**2 / variance
            ridge = 0.1 * np.r_[0.0, np.ones(3)]
            beta = beta + np.linalg.solve((d * v[:, None]).T @ d + np.diag(ridge), d.T @ (v * (y - mu) / slope) - ridge * beta)
        assert np.allclose(found[r], beta, atol=1e-6)
    told = validation.bootstrap(table, ["x"], "y", [[0.2], [0.8]], ModelSpec("multivariate" + family.capitalize(), glm=spec), replicates=60, row_id="row_id")
    assert told.status == "completed" and told.successful == 60
    for q, r in zip((0.2, 0.8), told.predictions.orderBy("id").collect()):
        assert r.sd == pytest.approx(model.standard_error([[q]])[0], rel=0.6) and r.lo < r.reference < r.hi


def test_sparse_solution_equals_dense(spark):
    i = np.arange(3000)
    table = frame(spark, a=(i % 40) * 1.0, b=(i * 7 % 31) * 1.0, y=np.sin(i) + i % 40)
    both = [fit_glm(table, ["a", "b"], "y", "gaussian", GlmSpec(terms=(Category(0), Category(1)), penalty=0.01, solver=s)) for s in ("sparseCGLS", "denseQR")]
    assert both[0].evidence["backend"] == "sparseCGLS" and both[0].evidence["solver_converged"] and both[1].evidence["backend"] == "gram"
    assert both[0].evidence["non_zero"] == 3000 + (i % 40 > 0).sum() + (i * 7 % 31 > 0).sum()
    assert np.allclose(both[0].model.coefficients, both[1].model.coefficients, atol=1e-8) and both[0].deviance == pytest.approx(both[1].deviance)


def test_fits_in_tasks_equal_plain_ones(spark):
    from driftglass.operators.local import AdaptiveLoess, LocalLikelihood, NadarayaWatson
    from driftglass.plans.concurrent import in_tasks

    random_ = np.random.default_rng(5)
    x = np.sort(random_.uniform(0, 10, 120))[:, None]
    y, counted = np.sin(x[:, 0]) + 0.2 * random_.standard_normal(120), random_.poisson(3, 120) * 1.0
    each = in_tasks(spark, 7)
    for kind, options in ((Loess, {"span": 0.3}), (NadarayaWatson, {"span": 0.2}), (AdaptiveLoess, {"degree": 1})):
        one, two = kind.fit(x, y, **options, robust_iterations=1), kind.fit(x, y, **options, robust_iterations=1, each=each)
        assert np.allclose(one.fitted, two.fitted, atol=1e-12) and np.allclose(one.leverage, two.leverage, atol=1e-12) and one.sigma == pytest.approx(two.sigma)
    one, two = (LocalLikelihood.fit(x, counted, 1, "poisson", 0.5, each=e) for e in (each, lambda f, n: f(np.arange(n))))
    assert np.allclose(one.fitted, two.fitted) and one.aic() == pytest.approx(two.aic())
    table = frame(spark, row_id=np.arange(120), x=x[:, 0], y=y)
    spec = ModelSpec(degree=1, spans=(0.4,), robust_iterations=0)
    one, two = (fit(table, ["x"], "y", spec, row_id="row_id", concurrent=c) for c in (False, True))
    assert np.allclose(one.fitted, two.fitted) and one.tuning.smoother == two.tuning.smoother and one.row_ids.tolist() == list(range(120))
    assert one.term_diagnostics() == [] and one.confidence_interval([[1.0]]) is None and one.sparse_evidence is None and one.gradient([[1.0]]).shape == (1, 1)


def test_work_can_be_called_off(spark):
    import threading
    import time

    from driftglass.plans.concurrent import Cancelled, cancellable

    def slow(batches):
        time.sleep(60)
        yield from batches

    began = time.time()
    with pytest.raises(Cancelled):
        with cancellable(spark) as handle:
            threading.Timer(3, handle.cancel).start()
            spark.range(4).mapInPandas(slow, "id long").count()
    assert time.time() - began < 40 and spark.range(3).count() == 3
    with pytest.raises(Cancelled):
        with cancellable(spark) as handle:
            handle.cancel()
    with cancellable(spark):
        assert spark.range(3).count() == 3


def test_records_round_trip(spark):
    import json

    from driftglass.plans import records

    i = np.arange(30)
    table = frame(spark, row_id=i, x=i * 1.0, y=np.sin(i) + i)
    spec = ModelSpec(degree=1, spans=(0.75,), robust_iterations=0, adaptive=False)
    one = validation.cross_validate(table, ["x"], "y", spec, folds=3, partitioning="blocked")
    back = records.validation_from_json(spark, records.validation_to_json(one))
    assert back.spec == one.spec and back.overall == one.overall and back.n == 30 and back.primary == one.primary
    assert sorted(map(tuple, back.predictions.collect())) == sorted(map(tuple, one.predictions.collect()))
    told = validation.compare(one, back)
    again = records.comparison_from_json(spark, records.comparison_to_json(told))
    assert again.status == "comparable" and again.summary == told.summary and again.losses.count() == 30
    assert records.comparison_from_json(spark, json.dumps({"status": "responseFamilyMismatch"})).losses is None
    boot = validation.bootstrap(table, ["x"], "y", [[3.0], [9.0]], spec, replicates=4)
    text = records.bootstrap_to_json(boot)
    assert records.bootstrap_to_json(records.bootstrap_from_json(spark, text)) == text
    scored = frame(spark, id=i, observed=(i % 2) * 1.0, predicted=(i + 1) / 32.0)
    found = validation.calibration(scored, 5)
    bins, summary = records.calibration_from_json(spark, records.calibration_to_json(found))
    assert summary == found[1] and bins.count() == 5
    with pytest.raises(ValueError):
        records.validation_to_json(one, most_rows=3)
    factors = frame(spark, a=(i % 5) * 1.0, y=i * 1.0)
    model = fit(factors, ["a"], "y", ModelSpec("multivariateGaussian", glm=GlmSpec(terms=(Category(0),), solver="sparseCGLS")))
    evidence = model.sparse_evidence
    assert records.SparseEvidence.from_json(evidence.to_json()) == evidence and evidence.rows == 30 and evidence.converged and evidence.limit
    older = {k: v for k, v in json.loads(evidence.to_json()).items() if k not in ("limit", "tolerance", "inference")}
    read = records.SparseEvidence.from_json(json.dumps(older))
    assert read.limit is None and read.tolerance is None and read.inference == "exactDenseCovariance"
    spline = fit(table, ["x"], "y", ModelSpec("additiveGaussian"))
    assert len(spline.term_diagnostics()) == 1 and len(spline.fitted) == 30


def test_ranks(spark):
    from driftglass.sources.staging import with_ranks

    random_ = np.random.default_rng(3)
    values = random_.integers(0, 30, 500)
    table = frame(spark, id=np.arange(500), v=values).repartition(5)
    got = {r.id: r["rank"] for r in with_ranks(table, ["v", "id"]).collect()}
    assert [got[i] for i in sorted(range(500), key=lambda i: (values[i], i))] == list(range(500))
    assert with_ranks(table.limit(0), ["v"]).count() == 0


def test_without_optional_parts(tmp_path):
    """Any of the optional parts may be deleted: the rest imports and has its queries."""
    import shutil
    import subprocess

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    say = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), sum(n.startswith('op') for n in q), 'pipeline' in q)"
    for k, gone in enumerate((["driftglass/llm"], ["corpus_pipeline.py"], ["driftglass/llm", "corpus_pipeline.py"])):
        copy = tmp_path / str(k)
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__", "*.json", "*.md"))
        for part in gone:
            target = copy / part
            if target.exists():
                shutil.rmtree(target) if target.is_dir() else target.unlink()
        told = subprocess.run([sys.executable, "-c", say], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})
        assert told.returncode == 0, told.stderr
        queries, oracles, ops, pipeline = told.stdout.split()[-4:]
        assert pipeline == "False" and (int(ops) == 0 if "driftglass/llm" in gone else True) and int(queries) - int(ops) == len(CORE.queries())


def test_residuals_sum_to_deviance(spark):
    y = (np.arange(30) >= 13) * 1.0
    table = frame(spark, x=np.linspace(-1, 1, 30), y=y)
    model = fit(table, ["x"], "y", ModelSpec("additiveBinomial"))
    total = model.residuals(table, "deviance").agg(F.sum(F.col("residual") * F.col("residual"))).head()[0]
    assert total == pytest.approx(model.diagnostics()["deviance"], rel=1e-6)
    zero = frame(spark, y=[0.0, 3.0], mu=[0.5, 2.0]).select(columns.residual("y", "mu", "pearson", "poisson").alias("p")).collect()
    assert [r.p for r in zero] == pytest.approx([-0.5 / 0.5**0.5, 1 / 2**0.5])


def test_groups_equal_single_fits(spark):
    rows = [(g, k, float(k), float(np.sin(k / 3 + g))) for g in range(3) for k in range(25)]
    table = spark.createDataFrame(rows, "g int, id int, x double, y double")
    got = fit_groups(table, ["g"], "x", "y", "id", lambda x, y: Whittaker.fit(x, y, 5.0, 2)).orderBy("g", "id").toPandas()
    for g in range(3):
        own = [r for r in rows if r[0] == g]
        assert np.allclose(got[got.g == g]["fit"], Whittaker.fit(np.array([r[2] for r in own]), np.array([r[3] for r in own]), 5.0, 2).fitted)
    with pytest.raises(ValueError):
        fit_groups(table, ["g"], "x", "y", "id", None, most_rows=5)


def test_streams(spark, tmp_path):
    frame(spark, x=[1.5, 2.5]).write.parquet(f"{tmp_path}/in")
    model = fit(frame(spark, x=np.arange(10.0), y=np.arange(10.0) + 0.25), ["x"], "y", ModelSpec(degree=1, spans=(0.9,), adaptive=False))
    stream = transform_stream(model, spark.readStream.schema("x double").parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("fitted").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.fit for r in spark.table("fitted").collect()) == pytest.approx([1.75, 2.75])


CORE = __spark_entry__._optional("driftglass.plans.catalogue")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in ("nation", "part", "orders", "lineitem", "events", "documents", "labels"):
        path = f"{DATA}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(CORE.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    ours = CORE.queries()[name](spark, DATA).toPandas()
    theirs = duck.sql(CORE.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours) == len(theirs)

    def plain(table):
        cells = table[sorted(table.columns)].astype(object).itertuples(index=False)
        return sorted((tuple("" if pd.isna(v) else v if isinstance(v, str) else float(v) for v in row) for row in cells), key=repr)

    for a, b in zip(plain(ours), plain(theirs)):
        assert all(x == y if isinstance(x, str) else x == pytest.approx(y, rel=1e-6, abs=1e-6) for x, y in zip(a, b)), (a, b)


def test_shuffled_folds_of_labels_equal_brute_force(spark, tmp_path):
    def brute(ids):
        held, state = sorted(ids), 42
        for last in reversed(range(1, len(held))):
            state = (6364136223846793005 * state + 1442695040888963407) & (2**64 - 1)
            other = state % (last + 1)
            held[last], held[other] = held[other], held[last]
        return {d: k % 7 for k, d in enumerate(held)}

    small = [(d * 7919 % 1009, 1, 0) for d in range(1000)]
    spark.createDataFrame(small, "doc_id long, quality int, toxic int").repartition(3).write.parquet(f"{tmp_path}/labels.parquet")
    for folder in (str(tmp_path), DATA):
        ids = [r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
        got = CORE.queries()["folds_shuffled_labels"](spark, folder).collect()
        assert len(got) == len(ids) == len(set(ids)) > 25 and {r.doc_id: r.fold for r in got} == brute(ids)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200


@pytest.mark.parametrize("points", ["grid", "line", "apart"])
def test_nearest_rows_of_any_number(spark, monkeypatch, points):
    """Equal points, ties and far-off rows; a table beyond what a local smoother holds is no error."""
    from driftglass.plans.spread import nearest_rows

    monkeypatch.setattr(binding, "MOST_ROWS", 100)
    random_ = np.random.default_rng(8)
    x = {"grid": random_.integers(0, 25, (1500, 2)).astype(float), "line": np.c_[np.zeros(900), np.arange(900.0) // 2],
         "apart": np.r_[random_.normal(size=(700, 2)), [[1e6, 0.0], [0.0, -1e7]], np.full((40, 2), 3.0)]}[points]
    keys = random_.permutation(len(x))
    table = spark.createDataFrame(pd.DataFrame({"id": keys, "a": x[:, 0], "b": x[:, 1]})).repartition(5)
    got = {(r["query"], r["rank"]): (r["neighbour"], r["d2"]) for r in nearest_rows(table, ["a", "b"], "id", 5, size=40).collect()}
    for at, key in enumerate(keys):
        d2 = ((x - x[at]) ** 2).sum(axis=1)
        order = np.lexsort((keys, d2))[:5]
        assert [got.pop((key, rank)) for rank in range(1, 6)] == [(keys[i], d2[i]) for i in order]
    assert not got


def test_nearest_rows_that_are_odd_or_few(spark):
    from driftglass.plans.spread import nearest_rows

    table = spark.createDataFrame([(5, 1.0, 1.0), (2, 1.0, 2.0), (9, None, 1.0), (1, 4.0, float("nan"))], "id long, a double, b double")
    got = {(r["query"], r["rank"]): (r["neighbour"], r["d2"]) for r in nearest_rows(table, ["a", "b"], "id", 3).collect()}
    assert [got[5, k] for k in (1, 2, 3)] == [(5, 0.0), (2, 1.0), (1, None)] and [got[9, k] for k in (1, 2, 3)] == [(1, None), (2, None), (5, None)]
    assert len(got) == 12 and nearest_rows(table.limit(0), ["a", "b"], "id", 3).count() == 0
    assert nearest_rows(table.limit(2), ["a", "b"], "id", 3).count() == 4


@pytest.mark.parametrize("span, size, ties", [(0.3, 40, False), (0.05, 16, True), (1.0, 64, True), (0.3, None, False)])
def test_local_means_of_any_number_of_rows(spark, monkeypatch, span, size, ties):
    """Equal to the local likelihood of degree 0; a table beyond what a local smoother holds is no error."""
    from driftglass.operators.local import LocalLikelihood
    from driftglass.plans.spread import local_means

    monkeypatch.setattr(binding, "MOST_ROWS", 100)
    random_ = np.random.default_rng(4)
    x = np.sort(np.r_[random_.integers(0, 300, 500) if ties else random_.permutation(4000)[:500], random_.normal(9e5, 3, 200), [-4e7]].astype(float))
    y = np.sin(x) + random_.normal(size=len(x))
    table = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).repartition(5)
    got = local_means(table, "x", "y", span, size=size).toPandas().sort_values(["x", "y"])
    order = np.lexsort((y, x))
    model = LocalLikelihood.fit(x[order][:, None], y[order], 0, "gaussian", span)
    assert np.array_equal(got["x"], x[order]) and np.array_equal(got["y"], y[order])
    assert np.allclose(got["fit"], model.fitted, rtol=0, atol=1e-9)


def test_local_means_of_few_equal_or_odd_rows(spark):
    from driftglass.plans.spread import local_means

    table = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0), (1.0, 6.0), (None, 1.0), (2.0, float("nan"))], "x double, y double")
    assert sorted(r.fit for r in local_means(table, "x", "y", 1.0).collect()) == [4.0, 4.0, 4.0]
    assert [r.fit for r in local_means(table.limit(1), "x", "y", 0.3).collect()] == [2.0] and local_means(table.limit(0), "x", "y", 0.3).count() == 0
