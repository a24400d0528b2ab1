"""One query for each operator, over the standard tables, and its SQL where SQL can say it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns, folds
from ..operators.additive import AdditiveModel
from ..operators.automatic import fit_automatic, select_span
from ..operators.glm import Category, GlmSpec, Spline, Tensor, fit_glm, sparse_choice, spline_columns
from ..operators.local import AdaptiveLoess, LocalLikelihood, Loess, NadarayaWatson
from ..operators.sequence import TotalVariation, Whittaker, select_penalty
from ..shipping import ship_package
from ..sources import binding
from . import contours, validation
from .catalogue_fit_sql import ORACLES as FIT_ORACLES
from .catalogue_sql import ORACLES
from .grouped import fit_groups
from .model import ModelSpec, evaluate, fit
from .spread import local_means, nearest_rows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- inputs that several queries share -----------------------------------------------------


def _order_days(spark, sf_dir) -> DataFrame:
    """(x, y): mean order price of each day, x in days since 1995-01-01."""
    day = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date"))
    return _table(spark, sf_dir, "orders").groupBy(day.cast("double").alias("x")).agg(F.avg("o_totalprice").alias("y"))


def _event_days(spark, sf_dir) -> DataFrame:
    """(x, y): mean event value of each day, x from 0."""
    day = F.col("ts").cast("date")
    days = _table(spark, sf_dir, "events").groupBy(day.alias("d")).agg(F.avg("value").alias("y"))
    return days.select((F.row_number().over(Window.orderBy("d")) - 1).cast("double").alias("x"), "y")


def _event_hours(spark, sf_dir) -> DataFrame:
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    return _table(spark, sf_dir, "events").groupBy(hour.alias("h")).agg(F.avg("value").alias("y"), F.count("*").alias("n"))


def _hours(spark, sf_dir) -> DataFrame:
    return _event_hours(spark, sf_dir).select((F.col("h") - F.min("h").over(Window.partitionBy())).cast("double").alias("x"), "y")


def _arrays(data: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    x, y, _ = binding.training_arrays(data.orderBy("x"), ["x"], "y", "x")
    return x, y


def _grid_of(data: DataFrame, count: int) -> DataFrame:
    """(g, x): count points from the smallest to the largest x."""
    low, high = data.agg(F.min("x"), F.max("x")).head()
    return data.sparkSession.range(count).select(F.col("id").cast("int").alias("g"), (F.lit(low) + F.lit(high - low) * F.col("id").cast("double") / F.lit(float(count - 1))).alias("x"))


# --- local regression ----------------------------------------------------------------------


def loess_deg1_grid(spark, sf_dir):
    """Local linear regression of the daily mean order price on 200 points (k = 10 % of the days)."""
    days = _order_days(spark, sf_dir)
    model = Loess.fit(*_arrays(days), 0.1, 1, robust_iterations=0)
    return evaluate(model, ["x"], _grid_of(days, 200)).select("g", F.round("fit", 4).alias("fit"))


def nw_grid(spark, sf_dir):
    """The kernel mean of the daily mean order price on 200 points."""
    days = _order_days(spark, sf_dir)
    model = NadarayaWatson.fit(*_arrays(days), 0.1, robust_iterations=0)
    return evaluate(model, ["x"], _grid_of(days, 200)).select("g", F.round("fit", 4).alias("fit"))


def nw_se(spark, sf_dir):
    """Standard errors of the kernel mean on 200 points."""
    days = _order_days(spark, sf_dir)
    model = NadarayaWatson.fit(*_arrays(days), 0.1, robust_iterations=0)
    return evaluate(model, ["x"], _grid_of(days, 200), errors=True).select("g", F.round("se", 4).alias("se"))


def loess_deg1_slopes(spark, sf_dir):
    """Slopes of the local lines of the daily mean order price on 200 points."""
    days = _order_days(spark, sf_dir)
    model = Loess.fit(*_arrays(days), 0.1, 1, robust_iterations=0)
    return evaluate(model, ["x"], _grid_of(days, 200), gradients=True).select("g", F.round(F.get("grad", F.lit(0)), 4).alias("slope"))


def loess_deg2_grid(spark, sf_dir):
    """Local quadratic regression of hourly event means at the hours themselves (k = 30 %)."""
    hours = _hours(spark, sf_dir)
    model = Loess.fit(*_arrays(hours), 0.3, 2, robust_iterations=0)
    return evaluate(model, ["x"], hours).select(F.col("x").cast("int").alias("hour"), F.round("fit", 6).alias("fit"))


def loess_robust(spark, sf_dir):
    """Robust local linear regression of 30 daily event means: three weight updates, then the final pass (k = 15)."""
    days = _event_days(spark, sf_dir)
    x, y = _arrays(days)
    model = Loess.fit(x, y, 0.5, 1, robust_iterations=2)
    return spark.createDataFrame([(int(d), round(float(f), 6), round(float(w), 6)) for d, f, w in zip(x[:, 0], model.fitted, model.weights)], "day int, fit double, weight double")


def nw_gcv_span(spark, sf_dir):
    """Generalised cross-validation of three spans of the kernel mean on 30 daily event means; the smallest score is chosen."""
    x, y = _arrays(_event_days(spark, sf_dir))
    spans = (0.2, 0.4, 0.8)
    best = select_span(NadarayaWatson, x, y, spans, robust_iterations=0).span
    fits = {s: NadarayaWatson.fit(x, y, s, robust_iterations=0) for s in spans}
    return spark.createDataFrame([(s, round(f.gcv(), 6), s == best) for s, f in fits.items()], "span double, gcv double, chosen boolean")


def adaptive_loess(spark, sf_dir):
    """Adaptive local regression of 720 hourly event means: fit and chosen neighbourhood of every hour."""
    x, y = _arrays(_hours(spark, sf_dir))
    model = AdaptiveLoess.fit(x, y, 1, robust_iterations=1)
    return spark.createDataFrame([(int(h), int(k), round(float(f), 6)) for h, k, f in zip(x[:, 0], model.selected, model.fitted)], "hour int, k int, fit double")


def adaptive_fast(spark, sf_dir):
    """Adaptive predictions on 200 points with the neighbourhood of the nearest training row."""
    hours = _hours(spark, sf_dir)
    model = AdaptiveLoess.fit(*_arrays(hours), 1, robust_iterations=1)
    return evaluate(model, ["x"], _grid_of(hours, 200), errors=True, fast=True).select("g", F.round("fit", 6).alias("fit"), F.round("se", 6).alias("se"))


def local_likelihood_poisson(spark, sf_dir):
    """Poisson local likelihood of hourly event counts."""
    rows = _event_hours(spark, sf_dir).select((F.col("h") - F.min("h").over(Window.partitionBy())).cast("double").alias("x"), F.col("n").cast("double").alias("y"))
    x, y = _arrays(rows)
    model = select_span(LocalLikelihood, x, y, (0.3, 0.5), degree=1, family="poisson")
    return evaluate(model, ["x"], rows, errors=True, gradients=True).select(F.col("x").cast("int").alias("hour"), F.round("fit", 5).alias("fit"), F.round("se", 5).alias("se"), F.round(F.get("grad", F.lit(0)), 5).alias("slope"))


def local_likelihood_mean(spark, sf_dir):
    """Binomial local likelihood of degree 0 of the toxic label along document ids: the locality-weighted share (k = 30 %)."""
    rows = _table(spark, sf_dir, "labels").filter("toxic is not null").groupBy(F.col("doc_id").cast("double").alias("x")).agg(F.max("toxic").cast("double").alias("y"))
    return local_means(rows, "x", "y", 0.3).select(F.col("x").cast("long").alias("doc_id"), F.round("fit", 4).alias("share"))


def automatic_smoother(spark, sf_dir):
    """The automatic choice of smoother for daily event means, with its fitted values."""
    x, y = _arrays(_event_days(spark, sf_dir))
    model, told = fit_automatic(x, y, degree=1, robust_iterations=1)
    return spark.createDataFrame([(told.smoother, int(d), round(float(f), 6)) for d, f in zip(x[:, 0], model.fitted)], "smoother string, day int, fit double")


# --- neighbours, boxes, policies -----------------------------------------------------------


def knn_topk(spark, sf_dir):
    """The 5 nearest parts by (size, price) of every part, nearest first, ties to the smaller key."""
    parts = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").cast("double").alias("b"))
    found = nearest_rows(parts, ["a", "b"], "p_partkey", 5)
    return found.select("query", "rank", F.col("neighbour").alias("p_partkey"), F.round("d2", 4).alias("d2"))


def extrapolation_policies(spark, sf_dir):
    """Fitted values of daily event means inside, and by policy outside, the range of days."""
    days = _event_days(spark, sf_dir)
    model = Loess.fit(*_arrays(days), 0.5, 1, robust_iterations=0)
    queries = spark.range(-5, 36).select(F.col("id").cast("double").alias("x"))
    out = None
    for policy in ("polynomial", "nearest", "unavailable"):
        part = evaluate(model, ["x"], queries, policy=policy).select(F.lit(policy).alias("policy"), F.col("x").cast("int").alias("day"), F.round(F.when(~F.isnan("fit"), F.col("fit")), 6).alias("fit"))
        out = part if out is None else out.union(part)
    return out


def bounding_box(spark, sf_dir):
    """Orders whose price and date are inside the box of the urgent ones."""
    orders = _table(spark, sf_dir, "orders").withColumns({"price": F.col("o_totalprice").cast("double"), "day": F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("double")})
    box = binding.bounding_box(orders.filter("o_orderpriority = '1-URGENT'"), ["price", "day"])
    return orders.select("o_orderkey", binding.in_box(["price", "day"], box).alias("inside"))


def finite_rows(spark, sf_dir):
    """Which events have a finite log of the value less 100 and a finite ratio."""
    events = _table(spark, sf_dir, "events")
    v = F.col("value").cast("double")
    made = events.select("event_id", F.when(v >= 100, F.log(v - 99.5)).when(v >= 50, F.lit(float("nan"))).when(v >= 20, F.lit(float("inf"))).alias("a"), v.alias("b"))
    return binding.finite_rows(made, ["a", "b"]).select("event_id", F.round("a", 6).alias("a"))


def response_family(spark, sf_dir):
    """The response families of three columns."""
    told = []
    for name, column in (("labels", "toxic"), ("lineitem", "l_quantity"), ("events", "value")):
        told.append((name, column, binding.response_family(_table(spark, sf_dir, name).select(column), column)))
    return spark.createDataFrame(told, "tab string, col string, family string")


def level_codes(spark, sf_dir):
    """Codes of the event types and how many events have each."""
    events = _table(spark, sf_dir, "events")
    table = binding.levels(events, "event_type")
    return binding.encode(events, "event_type", table, "code").groupBy("event_type", F.col("code").cast("int").alias("code")).agg(F.count("*").alias("n"))


def bin_means(spark, sf_dir):
    """Means of lineitem prices in bins of the quantity, 5 wide."""
    return binding.bin_rows(_table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 5.0).select("bin", F.round("x", 6).alias("x"), F.round("y", 3).alias("y"), "n")


# --- folds, bins, validation ---------------------------------------------------------------


def folds_blocked(spark, sf_dir):
    return folds.assign_folds(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", 7).select("doc_id", "fold")


def folds_shuffled(spark, sf_dir):
    """Shuffled folds of the 25 nations, seed 42."""
    return folds.assign_folds(_table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", 4, "shuffled", 42).select("n_nationkey", "fold")


def folds_shuffled_labels(spark, sf_dir):
    """Shuffled folds of all labels, seed 42."""
    return folds.assign_folds(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", 7, "shuffled", 42).select("doc_id", "fold")


def folds_stratified(spark, sf_dir):
    """Stratified folds of all labels: zeros and ones are dealt evenly on their own; counts per fold."""
    rows = _table(spark, sf_dir, "labels").filter("toxic is not null").select("doc_id", "toxic")
    return folds.assign_folds(rows, "doc_id", 5, "stratified", 7, "toxic").groupBy("fold", "toxic").agg(F.count("*").alias("n"))


def _scored_labels(spark, sf_dir) -> DataFrame:
    """(id, observed, predicted, other): two simple scores of the quality label from the documents' lengths."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = _table(spark, sf_dir, "labels").filter("quality is not null").select("doc_id", F.col("quality").cast("double").alias("observed"))
    n = F.col("n_chars").cast("double")
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("id"), "observed", (0.05 + 0.9 * n / (n + 300.0)).alias("predicted"), (0.5 + 0.4 * n / (n + 1000.0)).alias("other"), (F.col("doc_id") % 5).cast("int").alias("fold"))


def calibration_bins(spark, sf_dir):
    bins, _ = validation.calibration(_scored_labels(spark, sf_dir), 10)
    return bins.select("id", "n", *[F.round(c, 8).alias(c) for c in ("min_p", "max_p", "mean_p", "observed_frequency")])


def calibration_summary(spark, sf_dir):
    _, told = validation.calibration(_scored_labels(spark, sf_dir), 10)
    return spark.createDataFrame([(told["n"], told["bins"], *[round(told[k], 8) for k in ("prevalence", "mean_p", "brier", "ece")])], "n long, bins int, prevalence double, mean_p double, brier double, ece double")


def cv_metrics_binomial(spark, sf_dir):
    return validation.fold_metrics(_scored_labels(spark, sf_dir), "binomial", "fold").select("fold", "n", F.round("mean_deviance", 8).alias("mean_deviance"))


def cv_metrics_gaussian(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 6).cast("int").alias("fold"), F.col("o_totalprice").cast("double").alias("observed"), (F.col("o_custkey") * 10.0).cast("double").alias("predicted"))
    return validation.fold_metrics(rows, "gaussian", "fold").select("fold", "n", F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"))


def paired_comparison(spark, sf_dir):
    """Counts of a paired comparison of the two scores."""
    rows = _scored_labels(spark, sf_dir)
    a, b = rows.select("id", "fold", "observed", "predicted"), rows.select("id", "fold", "observed", F.col("other").alias("predicted"))
    _, counts = validation.paired_losses(a, b, "binomial")
    return counts.select("unpaired", "other_fold", "infinite", F.round("mean_difference", 8).alias("mean_difference"), "candidate_wins", "baseline_wins", "ties")


def residuals_binomial(spark, sf_dir):
    rows = _scored_labels(spark, sf_dir)
    return rows.select("id", *[F.round(columns.residual("observed", "predicted", k, "binomial"), 7).alias(k) for k in ("raw", "pearson", "deviance")])


def residuals_poisson(spark, sf_dir):
    """Residuals of hourly event counts about their mean."""
    hours = _event_hours(spark, sf_dir).select("h", F.col("n").cast("double").alias("n"), F.avg("n").over(Window.partitionBy()).alias("mu"))
    return hours.select("h", *[F.round(columns.residual("n", "mu", k, "poisson"), 7).alias(k) for k in ("raw", "pearson", "deviance")])


def cross_validation(spark, sf_dir):
    """Five-fold cross-validation of the automatic smoother on daily event means."""
    days = _event_days(spark, sf_dir).withColumn("row_id", F.col("x").cast("long"))
    found = validation.cross_validate(days, ["x"], "y", ModelSpec(degree=1, spans=(0.5, 0.75), robust_iterations=0, adaptive=False), partitioning="shuffled")
    return found.predictions.select("id", "fold", F.round("observed", 6).alias("observed"), F.round("predicted", 6).alias("predicted"))


def model_comparison(spark, sf_dir):
    """Paired comparison of an automatic smoother and a gaussian spline model on daily event means."""
    days = _event_days(spark, sf_dir).withColumn("row_id", F.col("x").cast("long"))
    one = validation.cross_validate(days, ["x"], "y", ModelSpec(degree=1, spans=(0.75,), robust_iterations=0, adaptive=False), partitioning="blocked", folds=3)
    two = validation.cross_validate(days, ["x"], "y", ModelSpec("additiveGaussian"), partitioning="blocked", folds=3)
    return validation.compare(one, two).losses.select("id", "fold", *[F.round(c, 5).alias(c) for c in ("baseline_loss", "candidate_loss", "difference")])


def bootstrap_summary(spark, sf_dir):
    """Mean, deviation and percentile interval of event values by type, as of replicas."""
    rows = _table(spark, sf_dir, "events").select((F.col("event_id") % 7).cast("int").alias("id"), F.col("value").cast("double").alias("value"))
    return validation.summarise_replicas(rows, 0.95).select("id", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "lo", "hi")])


def bootstrap_smoother(spark, sf_dir):
    """Bootstrap of a local line of daily event means at three points."""
    days = _event_days(spark, sf_dir)
    found = validation.bootstrap(days, ["x"], "y", [[5.0], [15.0], [25.0]], ModelSpec(degree=1, spans=(0.75,), robust_iterations=0, adaptive=False), replicates=40)
    return found.predictions.select("id", *[F.round(c, 6).alias(c) for c in ("reference", "mean", "sd", "lo", "hi")])


# --- sequences -----------------------------------------------------------------------------


def whittaker_order1(spark, sf_dir):
    x, y = _arrays(_event_days(spark, sf_dir))
    model = Whittaker.fit(x, y, 10.0, 1)
    return spark.createDataFrame([(int(d), round(float(f), 6)) for d, f in zip(x[:, 0], model.fitted)], "day int, fit double")


def whittaker_groups(spark, sf_dir):
    """A second-order Whittaker curve with errors of each user's events, users side by side."""
    events = _table(spark, sf_dir, "events")
    return fit_groups(events, ["user_id"], "ts", "value", "event_id", lambda x, y: Whittaker.fit(x, y, 100.0, 2)).select("user_id", "event_id", *[F.round(F.when(~F.isnan(c), F.col(c)), 6).alias(c) for c in ("fit", "se")])


def whittaker_interpolation(spark, sf_dir):
    """Linear interpolation of the daily curve at half days, outside it nothing."""
    days = _event_days(spark, sf_dir)
    model = Whittaker.fit(*_arrays(days), 10.0, 1)
    queries = spark.range(-2, 62).select((F.col("id") / 2.0).alias("x"))
    return evaluate(model, ["x"], queries, gradients=True).select(F.col("x"), F.round(F.when(~F.isnan("fit"), F.col("fit")), 6).alias("fit"), F.round(F.get("grad", F.lit(0)), 6).alias("slope"))


def whittaker_gcv(spark, sf_dir):
    """The penalty of the smallest GCV among four, and its curve."""
    x, y = _arrays(_hours(spark, sf_dir))
    model = select_penalty(Whittaker, x, y, (1.0, 10.0, 100.0, 1000.0), order=2, errors=False)
    return spark.createDataFrame([(model.penalty, int(h), round(float(f), 6)) for h, f in zip(x[:, 0], model.fitted)], "penalty double, hour int, fit double")


def total_variation(spark, sf_dir):
    """The total-variation curve of hourly event means and its segments."""
    x, y = _arrays(_hours(spark, sf_dir))
    model = TotalVariation.fit(x, y, 20.0)
    rows = spark.createDataFrame([(int(h), float(f)) for h, f in zip(x[:, 0], model.fitted)], "hour int, fit double")
    jump = F.coalesce(F.abs(F.col("fit") - F.lag("fit").over(Window.orderBy("hour"))) > 1e-6, F.lit(False))
    return rows.withColumn("segment", F.sum(jump.cast("int")).over(Window.orderBy("hour"))).withColumn("fit", F.round("fit", 9))


def tv_nearest(spark, sf_dir):
    """Nearest-day values (ties to the earlier) of the total-variation curve of daily means at third days."""
    days = _event_days(spark, sf_dir)
    model = TotalVariation.fit(*_arrays(days), 2.0)
    queries = spark.range(0, 88).select(F.col("id").cast("int").alias("third"), (F.col("id") / 3.0).alias("x"))
    return evaluate(model, ["x"], queries).select("third", F.round("fit", 9).alias("fit"))


def segment_count(spark, sf_dir):
    """Segments of daily event means rounded to tens: jumps above a tolerance, by lag."""
    days = _event_days(spark, sf_dir).withColumn("z", F.round(F.col("y") / 10) * 10)
    return days.withColumn("jump", (F.abs(F.col("z") - F.lag("z").over(Window.orderBy("x"))) > 1e-6).cast("int")).agg((F.sum("jump") + 1).alias("segments"))


# --- likelihood and additive models --------------------------------------------------------


def _line_factors(spark, sf_dir) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0)
    return _table(spark, sf_dir, "lineitem").select(flag.alias("flag"), F.round(F.col("l_discount").cast("double") * 100).alias("discount"), F.col("l_quantity").cast("double").alias("quantity"), (F.col("l_extendedprice").cast("double") / 1000).alias("price"))


def ridge_factor_gaussian(spark, sf_dir):
    """Effects of two return flags against the third on the price, by ridge-penalised least squares summed where the rows are."""
    found = fit_glm(_line_factors(spark, sf_dir), ["flag"], "price", "gaussian", GlmSpec(terms=(Category(0, (0, 1, 2)),), penalty=50.0))
    b = found.model.coefficients
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(b)], "k int, beta double")


def gram_spline_design(spark, sf_dir):
    """Sums of products of the spline columns of the quantity (native expressions, one aggregate)."""
    lines = _line_factors(spark, sf_dir)
    low, high = lines.agg(F.min("quantity"), F.max("quantity")).head()
    b = spline_columns(F.col("quantity"), low, high, 1)
    sums = [F.round(F.sum(b[i] * b[j]), 4).alias(f"g{i}{j}") for i in range(4) for j in range(i, 4)]
    return lines.agg(*sums)


def categorical_factors(spark, sf_dir):
    """Two factors (flag, discount in percent) on the price; coefficients, and errors of the link."""
    found = fit_glm(_line_factors(spark, sf_dir), ["flag", "discount"], "price", "gaussian", GlmSpec(terms=(Category(0), Category(1)), penalty=1e-3))
    m = found.model
    return spark.createDataFrame([(k, round(float(v), 6), round(float(np.sqrt(m.covariance[k, k])), 6)) for k, v in enumerate(m.coefficients)], "k int, beta double, se double")


def additive_binomial(spark, sf_dir):
    """The toxic label by a spline of the document's length: fitted probabilities with intervals."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.log(F.col("n_chars").cast("double") + 1).alias("size"))
    labels = _table(spark, sf_dir, "labels").filter("toxic is not null").select("doc_id", F.col("toxic").cast("double").alias("y"))
    rows = labels.join(docs, "doc_id")
    model = fit(rows, ["size"], "y", ModelSpec("additiveBinomial"))
    return model.transform(rows.select("doc_id", "size"), errors=True, level=0.95).select("doc_id", *[F.round(c, 6).alias(c) for c in ("fit", "se", "lo", "hi")])


def additive_poisson(spark, sf_dir):
    """Hourly event counts by splines of the hour and of the hour of day."""
    rows = _event_hours(spark, sf_dir).select("h", (F.col("h") % 24).cast("double").alias("of_day"), (F.col("h") - F.min("h").over(Window.partitionBy())).cast("double").alias("hour"), F.col("n").cast("double").alias("n"))
    model = fit(rows, ["hour", "of_day"], "n", ModelSpec("additivePoisson"))
    return model.transform(rows, gradients=True).select("h", F.round("fit", 5).alias("fit"), F.round(F.get("grad", F.lit(0)), 6).alias("slope"))


def tensor_surface(spark, sf_dir):
    """Contour lines of the price over quantity and discount, from splines and their tensor product."""
    model = fit(_line_factors(spark, sf_dir), ["quantity", "discount"], "price", ModelSpec("multivariateGaussian", glm=GlmSpec(terms=(), spatial=Tensor(0, 1), penalty=0.1)))
    surface = model.contour(0, 1, [25.0, 5.0], 20, 12)
    low, high = surface["value"].min(), surface["value"].max()
    lines = contours.segments(spark.createDataFrame(surface), [float(low + (high - low) * k / 4) for k in (1, 2, 3)])
    return lines.select(F.round("level", 5).alias("level"), F.col("yi").cast("int").alias("yi"), F.col("xi").cast("int").alias("xi"), "part", *[F.round(c, 5).alias(c) for c in ("x0", "y0", "x1", "y1")])


def partial_effects(spark, sf_dir):
    """The effect of the quantity on the price along its range, with an interval."""
    model = fit(_line_factors(spark, sf_dir), ["quantity", "discount"], "price", ModelSpec("multivariateGaussian", glm=GlmSpec(terms=(Spline(0, 3), Spline(1, 1)), penalty=0.1)))
    return spark.createDataFrame(model.partial_effect(0, 50, 0.9)).select("predictor", *[F.round(c, 6).alias(c) for c in ("x", "effect", "grad", "lo", "hi")])


def additive_backfitting(spark, sf_dir):
    """Backfitted local lines of hourly event means along the hours and over the hour of day: both components of every hour."""
    rows = _event_hours(spark, sf_dir).select("h", (F.col("h") - F.min("h").over(Window.partitionBy())).cast("double").alias("hour"), (F.col("h") % 24).cast("double").alias("of_day"), "y")
    x, y, ids = binding.training_arrays(rows, ["hour", "of_day"], "y", "h")
    model = AdditiveModel.fit(x, y, [(0, 0.3, 1), (1, 0.5, 1)], tolerance=1e-10)
    effects = model.contributions(x)
    return spark.createDataFrame([(int(i), round(float(a), 6), round(float(b), 6), round(float(f), 6)) for i, (a, b), f in zip(ids, effects, model.fitted)], "h long, of_hour double, of_day double, fit double")


def contour_segments(spark, sf_dir):
    """Contour lines of x^2 + y^2 - x y on a grid."""
    surface = contours.grid(spark, (-2.0, 2.0), (-1.0, 3.0), 21, 17).withColumn("value", F.col("x") * F.col("x") + F.col("y") * F.col("y") - F.col("x") * F.col("y"))
    out = contours.segments(surface, [0.5, 1.5, 3.0])
    return out.select("level", "yi", "xi", "part", *[F.round(c, 8).alias(c) for c in ("x0", "y0", "x1", "y1")])


def sparse_dispatch(spark, sf_dir):
    """For every pair of text columns of lineitem: whether their factor design counts as sparse."""
    lines = _table(spark, sf_dir, "lineitem")
    names = ["l_returnflag", "l_linestatus", "l_quantity", "l_suppkey"]
    told = lines.agg(F.count("*").alias("n"), *[F.countDistinct(c).alias(c) for c in names]).head()
    rows = []
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            p = 1 + told[a] - 1 + told[b] - 1
            rows.append((a, b, told["n"], p, sparse_choice(told["n"], p, 3 / p)))
    return spark.createDataFrame(rows, "a string, b string, n long, p long, sparse boolean")


def link_functions(spark, sf_dir):
    """Means and kernels of a scaled event value."""
    u = F.col("value").cast("double") / 100 - 2
    return _table(spark, sf_dir, "events").select("event_id", *[F.round(c, 8).alias(n) for n, c in (
        ("logit", columns.link_mean(u, "binomial")), ("log", columns.link_mean(u, "poisson")), ("tricube", columns.tricube(u)), ("bisquare", columns.bisquare(u)), ("soft", columns.soft_threshold(u, 0.5)))])


def quadratic_forms(spark, sf_dir):
    """x' M x of three event features."""
    v = F.col("value").cast("double") / 100
    row = F.array(F.lit(1.0), v, (F.col("user_id") % 10).cast("double"))
    return _table(spark, sf_dir, "events").select("event_id", F.round(columns.quadratic_form(row, [[1.0, 0.5, 0.0], [0.5, 2.0, -0.25], [0.0, -0.25, 0.125]]), 8).alias("q"))


def queries() -> dict:
    local = [loess_deg1_grid, nw_grid, nw_se, loess_deg1_slopes, loess_deg2_grid, loess_robust, nw_gcv_span, adaptive_loess, adaptive_fast, local_likelihood_poisson, local_likelihood_mean, automatic_smoother]
    rows = [knn_topk, extrapolation_policies, bounding_box, finite_rows, response_family, level_codes, bin_means, folds_blocked, folds_shuffled, folds_shuffled_labels, folds_stratified]
    checked = [calibration_bins, calibration_summary, cv_metrics_binomial, cv_metrics_gaussian, paired_comparison, residuals_binomial, residuals_poisson, cross_validation, model_comparison, bootstrap_summary, bootstrap_smoother]
    curves = [whittaker_order1, whittaker_groups, whittaker_interpolation, whittaker_gcv, total_variation, tv_nearest, segment_count]
    models = [ridge_factor_gaussian, gram_spline_design, categorical_factors, additive_binomial, additive_poisson, tensor_surface, partial_effects, additive_backfitting, contour_segments, sparse_dispatch, link_functions, quadratic_forms]
    return {f.__name__: f for f in [*local, *rows, *checked, *curves, *models]}


def oracle_sql() -> dict[str, str]:
    return ORACLES | FIT_ORACLES
