"""Cross-validation, calibration, paired comparison and bootstrap."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import deviance, loss
from ..functions.generators import draws
from ..functions.folds import DEFAULT_SEED, assign_folds, equal_frequency_bin
from ..shipping import ship_package
from ..sources.binding import MOST_ROWS, as_number, finite_rows, response_family, training_arrays
from ..sources.staging import stage, with_ranks
from ..operators.glm import fit_replicas
from .model import ModelSpec, fit, fit_arrays

PARTITIONINGS = ("blocked", "shuffled", "stratified")


@dataclass
class Validation:
    """Out-of-fold predictions (id, fold, observed, predicted), metrics per fold and over all rows."""

    family: str
    spec: ModelSpec
    predictions: DataFrame
    folds: DataFrame
    overall: dict
    n: int

    @property
    def primary(self) -> float:
        return self.overall["rmse"] if self.family == "gaussian" else self.overall["mean_deviance"]


def fold_metrics(predictions: DataFrame, family: str, *by: str) -> DataFrame:
    """n, rmse, mae and mean_deviance of (observed, predicted), by fold or over all rows."""
    error = F.col("observed") - F.col("predicted")
    none = F.lit(None).cast("double")
    gaussian = family == "gaussian"
    return predictions.groupBy(*by).agg(
        F.count("*").alias("n"), (F.sqrt(F.avg(error * error)) if gaussian else F.max(none)).alias("rmse"), (F.avg(F.abs(error)) if gaussian else F.max(none)).alias("mae"),
        (F.max(none) if gaussian else F.avg(deviance("observed", "predicted", family))).alias("mean_deviance"))


def cross_validate(data: DataFrame, features: list[str], response: str, spec: ModelSpec = ModelSpec(), row_id: str = "row_id", folds: int = 5,
                   partitioning: str = "shuffled", seed: int = DEFAULT_SEED) -> Validation | None:
    """Refit the whole specification for each fold on the others' rows and predict the fold; None if a fold fails.

    Smoothers' folds run side by side, one task each (their rows are bounded); likelihood models are fitted over the DataFrame
    fold by fold. Folds and predictions are written to the shared folder, so nothing is fitted twice.
    """
    ship_package(data.sparkSession)
    if not spec.valid or partitioning not in PARTITIONINGS or folds < 2:
        return None
    rows = data.select(F.col(row_id).alias("id"), *[as_number(data, c).alias(c) for c in features], F.col(response).cast("double").alias("__y"))
    rows = finite_rows(rows, [*features, "__y"])
    n = rows.count()
    if n < max(3, folds):
        return None
    family = spec.family or response_family(rows, "__y")
    if partitioning == "stratified" and family != "binomial":
        return None
    dealt = stage(assign_folds(rows, "id", folds, partitioning, seed, "__y"), "folds")
    if dealt.select("fold").distinct().count() < folds:
        return None
    spark = data.sparkSession
    schema = f"id {dict(rows.dtypes)['id']}, fold int, observed double, predicted double"
    if spec.strategy in ("automaticSmoothing", "additiveGaussian"):
        if n > MOST_ROWS:
            raise ValueError(f"smoothers are validated on at most {MOST_ROWS} rows; bin the rows first")
        held = dealt.orderBy("id").toPandas()
        shared = spark.sparkContext.broadcast(held)

        def run(batches):
            for batch in batches:
                for fold in batch["fold"]:
                    table = shared.value
                    out = table["fold"] == fold
                    train, test = table[~out], table[out]
                    model = fit_arrays(train[features].to_numpy(float), train["__y"].to_numpy(float), train["id"].to_numpy(), features, response, spec)
                    value = np.full(len(test), np.nan) if model is None else model.predict(test[features].to_numpy(float))
                    yield pd.DataFrame({"id": test["id"], "fold": fold, "observed": test["__y"], "predicted": value})

        which = spark.range(folds).select(F.col("id").cast("int").alias("fold")).repartition(folds, "fold")
        predictions = which.mapInPandas(run, schema)
    else:
        predictions = None
        for fold in range(folds):
            model = fit(dealt.filter(F.col("fold") != fold), features, "__y", spec)
            if model is None:
                return None
            part = model.transform(dealt.filter(F.col("fold") == fold)).select("id", "fold", F.col("__y").alias("observed"), F.col("fit").alias("predicted"))
            predictions = part if predictions is None else predictions.union(part)
    predictions = stage(predictions, "predictions")
    bad = predictions.filter(F.isnan("predicted") | F.col("predicted").isNull() | (F.abs("predicted") == float("inf"))).limit(1).count()
    if bad:
        return None
    overall = fold_metrics(predictions, family).head().asDict()
    return Validation(family, spec, predictions.orderBy("id"), fold_metrics(predictions, family, "fold").withColumnRenamed("fold", "id"), overall, n)


def calibration(predictions: DataFrame, bins: int = 10) -> tuple[DataFrame, dict] | None:
    """(bins, summary) of out-of-fold probabilities: equal-frequency bins by (predicted, id); None unless all are 0/1 and within 0..1."""
    p, y = F.col("predicted"), F.col("observed")
    n, wrong = predictions.agg(F.count("*"), F.count_if(~y.isin(0.0, 1.0) | p.isNull() | F.isnan(p) | (p < 0) | (p > 1) | y.isNull())).head()
    if not n or wrong or bins < 1:
        return None
    used = min(bins, n)
    ranked = with_ranks(predictions, ["predicted", "id"], "place")
    table = (ranked.withColumn("bin", equal_frequency_bin(F.col("place"), n, used)).groupBy(F.col("bin").alias("id"))
             .agg(F.count("*").alias("n"), F.min(p).alias("min_p"), F.max(p).alias("max_p"), F.avg(p).alias("mean_p"), F.avg(y).alias("observed_frequency")))
    whole = predictions.agg(F.avg(y).alias("prevalence"), F.avg(p).alias("mean_p"), F.avg((y - p) * (y - p)).alias("brier")).head().asDict()
    ece = table.agg(F.sum(F.col("n") / n * F.abs(F.col("observed_frequency") - F.col("mean_p")))).head()[0]
    return table, {"n": n, "bins": used, **whole, "ece": ece}


@dataclass
class Comparison:
    status: str
    summary: dict = field(default_factory=dict)
    losses: DataFrame | None = None


def compare(baseline: Validation, candidate: Validation) -> Comparison:
    """Pair the held-out losses of two validations.

    Statuses: comparable, responseFamilyMismatch, heldOutObservationsMismatch, foldAssignmentMismatch, checked in that order.
    """
    if baseline.family != candidate.family:
        return Comparison("responseFamilyMismatch")
    losses, counts = paired_losses(baseline.predictions, candidate.predictions, baseline.family)
    told = counts.head()
    if told.unpaired or told.infinite:
        return Comparison("heldOutObservationsMismatch")
    if told.other_fold:
        return Comparison("foldAssignmentMismatch")
    summary = {k: told[k] for k in ("mean_difference", "candidate_wins", "baseline_wins", "ties")}
    return Comparison("comparable", {"family": baseline.family, "baseline": baseline.primary, "candidate": candidate.primary, **summary}, losses)


def paired_losses(baseline: DataFrame, candidate: DataFrame, family: str) -> tuple[DataFrame, DataFrame]:
    """(id, fold, baseline_loss, candidate_loss, difference) by one full join, and a row of counts over it."""
    a = baseline.select(F.col("id").alias("aid"), F.col("fold").alias("af"), F.col("observed").alias("ay"), F.col("predicted").alias("ap"))
    b = candidate.select(F.col("id").alias("bid"), F.col("fold").alias("bf"), F.col("observed").alias("by"), F.col("predicted").alias("bp"))
    both = a.join(b, F.col("aid") == F.col("bid"), "full")
    la, lb = loss("ay", "ap", family), loss("by", "bp", family)
    told = both.select("aid", "bid", "af", "bf", "ay", "by", la.alias("la"), lb.alias("lb"), (lb - la).alias("d"))
    tolerance = 1e-12 * F.greatest(F.lit(1.0), F.abs("la"), F.abs("lb"))
    infinite = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    counts = told.agg(
        F.count_if(F.col("aid").isNull() | F.col("bid").isNull() | (F.col("ay") != F.col("by"))).alias("unpaired"), F.count_if(F.col("af") != F.col("bf")).alias("other_fold"),
        F.count_if(infinite("la") | infinite("lb")).alias("infinite"), F.avg("d").alias("mean_difference"), F.count_if(F.col("d") < -tolerance).alias("candidate_wins"),
        F.count_if(F.col("d") > tolerance).alias("baseline_wins"), F.count_if(F.abs("d") <= tolerance).alias("ties"))
    return told.select(F.col("aid").alias("id"), F.col("af").alias("fold"), F.col("la").alias("baseline_loss"), F.col("lb").alias("candidate_loss"), F.col("d").alias("difference")), counts


@dataclass
class Bootstrap:
    """Statuses: completed, invalidInput, referenceFitFailure, insufficientSuccessfulReplicates."""

    status: str
    family: str | None = None
    attempted: int = 0
    successful: int = 0
    predictions: DataFrame | None = None

    @property
    def success_fraction(self) -> float:
        return self.successful / self.attempted if self.attempted else 0.0


def bootstrap(data: DataFrame, features: list[str], response: str, queries, spec: ModelSpec = ModelSpec(), replicates: int = 200, seed: int = DEFAULT_SEED,
              level: float = 0.95, least_success: float = 0.9, row_id: str | None = None) -> Bootstrap:
    """Refit resampled rows and summarise predictions at the query points.

    Replica r draws from a generator seeded by (seed, r), so results do not depend on where it runs. Smoothers, whose rows are bounded, are
    refitted side by side in tasks; likelihood models are refitted all at once where the rows are (fit_replicas).
    """
    queries = np.asarray(queries, float)
    queries = queries.reshape(-1, len(features)) if queries.ndim < 2 else queries
    if not spec.valid or replicates < 2 or not 0 < level < 1 or not 0 < least_success <= 1 or not len(queries) or queries.shape[1] != len(features) or not np.isfinite(queries).all():
        return Bootstrap("invalidInput")
    spark = data.sparkSession
    reference = fit(data, features, response, spec, row_id)
    if reference is None or not np.isfinite(told := reference.predict(queries)).all():
        return Bootstrap("referenceFitFailure", reference and reference.family)
    if spec.strategy not in ("automaticSmoothing", "additiveGaussian"):
        numbers = data.select(*[as_number(data, c).alias(c) for c in [*features, response]], *([F.col(row_id)] if row_id and row_id not in [*features, response] else []))
        found = fit_replicas(numbers, features, response, reference.model, spec.glm, replicates, seed, row_id)
        values = []
        for r, beta in enumerate(found):
            told_r = None if beta is None else replace(reference.model, coefficients=beta).predict(queries)
            if told_r is not None and np.isfinite(told_r).all():
                values += [(r, q, float(v)) for q, v in enumerate(told_r)]
        table = spark.createDataFrame(values, "replica int, id int, value double")
    else:
        x, y, _ = training_arrays(data, features, response, row_id, drop_missing=True)
        if len(y) < 2:
            return Bootstrap("referenceFitFailure", reference.family)
        shared = spark.sparkContext.broadcast((x, y))

        def run(batches):
            for batch in batches:
                for r in batch["id"]:
                    bx, by = shared.value
                    draw = draws(seed, int(r), len(by))
                    model = fit_arrays(bx[draw], by[draw], np.arange(len(by)), features, response, spec)
                    p = None if model is None else model.predict(queries)
                    if p is not None and np.isfinite(p).all():
                        yield pd.DataFrame({"replica": np.full(len(p), r), "id": np.arange(len(p)), "value": p})

        table = spark.range(replicates).repartition(min(replicates, 64)).mapInPandas(run, "replica int, id int, value double")
        table = stage(table, "replicas")
    successes = table.select("replica").distinct().count()
    if successes < int(np.ceil(least_success * replicates)):
        return Bootstrap("insufficientSuccessfulReplicates", reference.family, replicates, successes)
    points = spark.createDataFrame([(k, [float(v) for v in q], float(r)) for k, (q, r) in enumerate(zip(queries, told))], "id int, query array<double>, reference double")
    return Bootstrap("completed", reference.family, replicates, successes, points.join(summarise_replicas(table, level), "id"))


def summarise_replicas(table: DataFrame, level: float = 0.95) -> DataFrame:
    """(id, mean, sd, lo, hi) of (id, value): the percentile interval interpolates linearly."""
    low = (1 - level) / 2
    return table.groupBy("id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.percentile("value", F.lit(low)).alias("lo"), F.percentile("value", F.lit(1 - low)).alias("hi"))
