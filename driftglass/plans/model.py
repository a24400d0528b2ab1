"""The front door: a specification, a fit, and a fitted model that transforms DataFrames."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import residual
from ..operators.additive import AdditiveModel
from ..operators.automatic import SPANS, Tuning, fit_automatic
from ..operators.glm import Category, GlmModel, GlmResult, GlmSpec, Spline, Tensor, fit_glm
from ..operators.local import POLICIES, whole
from ..shipping import ship_package
from .concurrent import in_tasks
from ..sources.binding import MOST_ROWS, as_number, finite_rows, training_arrays

STRATEGIES = ("automaticSmoothing", "additiveGaussian", "additiveBinomial", "additivePoisson", "multivariateGaussian", "multivariateBinomial", "multivariatePoisson")
_TERMS = {"spline": Spline, "tensor": Tensor, "category": Category}


@dataclass(frozen=True)
class ModelSpec:
    """What to fit. additive: (predictor, span, degree) triples of the gaussian additive model; glm: of all likelihood models."""

    strategy: str = "automaticSmoothing"
    degree: int = 2
    spans: tuple[float, ...] | None = None
    robust_iterations: int = 4
    adaptive: bool = True
    additive: tuple[tuple[int, float, int], ...] | None = None
    glm: GlmSpec = field(default_factory=GlmSpec)

    @property
    def valid(self) -> bool:
        if self.strategy not in STRATEGIES:
            return False
        if self.strategy == "automaticSmoothing":
            return self.degree in (0, 1, 2) and self.robust_iterations >= 0 and (self.spans is None or bool(self.spans) and all(np.isfinite(s) and 0 < s <= 1 for s in self.spans))
        return True

    @property
    def family(self) -> str | None:
        """The family that the strategy fixes; None if the responses decide."""
        return None if self.strategy == "automaticSmoothing" else next(f for f in ("gaussian", "binomial", "poisson") if self.strategy.lower().endswith(f))

    def to_json(self) -> str:
        told = asdict(self)
        names = {v: k for k, v in _TERMS.items()}
        term = lambda t: None if t is None else {"kind": names[type(t)], **asdict(t)}
        told["glm"] |= {"terms": None if self.glm.terms is None else [term(t) for t in self.glm.terms], "spatial": term(self.glm.spatial), "temporal": term(self.glm.temporal)}
        return json.dumps(told)

    @classmethod
    def from_json(cls, text: str) -> ModelSpec:
        """Read a specification; what an older one does not name has its default."""
        told = json.loads(text)
        glm = told.pop("glm", None) or {}

        def term(t):
            if t is None:
                return None
            t = dict(t)
            kind = _TERMS[t.pop("kind")]
            return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in t.items()})

        glm = {**glm, **{k: term(glm.get(k)) for k in ("spatial", "temporal")}, "terms": None if glm.get("terms") is None else tuple(map(term, glm["terms"]))}
        told |= {k: tuple(tuple(v) if isinstance(v, list) else v for v in told[k]) for k in ("spans", "additive") if told.get(k) is not None}
        return cls(**told, glm=GlmSpec(**glm))


def evaluate(model, features: list[str], data: DataFrame, policy: str = "polynomial", errors=False, gradients=False, fast=False, level: float | None = None) -> DataFrame:
    """data with fit (NaN where there is none), and on demand se, grad, lo and hi.

    The model (its size is bounded by the fit) is broadcast once; rows are worked on where they are, batch by batch. Works on
    a streaming DataFrame too.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown extrapolation policy {policy!r}")
    spark = data.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    names = [f"__x{k}" for k in range(len(features))]
    added = "fit double" + ", se double" * errors + ", grad array<double>" * gradients + ", lo double, hi double" * (level is not None)
    rows = data.select(F.struct(*[F.col(c) for c in data.columns]).alias("__row"), *[as_number(data, c).alias(n) for c, n in zip(features, names)])

    def run(batches):
        fitted = shared.value
        for batch in batches:
            x = batch[names].to_numpy(float, na_value=np.nan).reshape(len(batch), len(names))
            out = batch[["__row"]].copy()
            out["fit"] = fitted.predict(x, policy, fast) if len(x) else np.empty(0)
            if errors:
                e = fitted.standard_error(x, policy, fast) if len(x) else np.empty(0)
                out["se"] = np.nan if e is None else e
                out["se"] = out["se"].where(out["se"].notna(), None)
            if gradients:
                g = fitted.gradient(x) if len(x) else np.empty((0, 1))
                out["grad"] = [None if np.isnan(v).any() else v.tolist() for v in g]
            if level is not None:
                out["lo"], out["hi"] = fitted.interval(x, level)
            yield out

    inner = rows.select("__row").schema["__row"].dataType.simpleString()
    return rows.mapInPandas(run, f"__row {inner}, {added}").select("__row.*", *[part.split(" ")[0] for part in added.split(", ")])


@dataclass
class FittedModel:
    """A fit with the names of its columns and how to use it on DataFrames."""

    model: object
    spec: ModelSpec
    features: list[str]
    response: str
    tuning: Tuning | None = None
    result: GlmResult | None = None

    @property
    def family(self) -> str:
        return self.model.family

    def transform(self, data: DataFrame, **options) -> DataFrame:
        return evaluate(self.model, self.features, data, **options)

    def predict(self, x, policy="polynomial") -> np.ndarray:
        return self.model.predict(np.asarray(x, float).reshape(-1, len(self.features)), policy)

    def diagnostics(self) -> dict:
        m = self.model
        if isinstance(m, GlmModel):
            return m.diagnostics()
        out = {"family": m.family, "link": {"gaussian": "identity", "binomial": "logit", "poisson": "log"}[m.family], "n": len(m.y), "edf": float(m.trace), "scale": float(m.sigma)}
        return out | {k: getattr(m, k, None) for k in ("deviance", "null_deviance")}

    @property
    def row_ids(self) -> np.ndarray | None:
        """Ids of the training rows that were kept; likelihood models hold none."""
        return getattr(self.model, "row_ids", None)

    @property
    def fitted(self) -> np.ndarray | None:
        """Fitted means of the training rows, in the order of row_ids; likelihood models hold none (transform the rows instead)."""
        return getattr(self.model, "fitted", None)

    @property
    def sparse_evidence(self):
        """How a sparse system was solved (plans.records.SparseEvidence), None if none was."""
        from .records import SparseEvidence

        told = self.result.evidence if self.result else {}
        if told.get("backend") != "sparseCGLS":
            return None
        m = self.model
        return SparseEvidence(told["rows"], told["columns"], told["non_zero"], told["solver_iterations"], told["solver_residual"], told["solver_converged"], m.deviance,
                              float(m.objective - m.deviance / 2), told["solver_limit"], told["solver_tolerance"], told["inference"])

    def term_diagnostics(self) -> list[dict]:
        """A summary of each term of an additive model; empty for smoothers and models without term smoothers."""
        if isinstance(self.model, AdditiveModel):
            return [t.diagnostics() for t in self.model.terms]
        return self.model.term_diagnostics() if isinstance(self.model, GlmModel) else []

    def confidence_interval(self, x, level: float = 0.95) -> tuple[np.ndarray, np.ndarray] | None:
        """(low, high) of the mean where the model has one: likelihood models alone."""
        return self.model.interval(np.asarray(x, float).reshape(-1, len(self.features)), level) if isinstance(self.model, GlmModel) else None

    def gradient(self, x) -> np.ndarray:
        return self.model.gradient(np.asarray(x, float).reshape(-1, len(self.features)))

    def residuals(self, data: DataFrame, kind: str = "raw") -> DataFrame:
        """data with fit and residual, as expressions over the evaluated rows."""
        scale = self.model.scale if isinstance(self.model, GlmModel) else self.model.sigma
        return self.transform(data).withColumn("residual", residual(self.response, "fit", kind, self.family, scale))

    def partial_effect(self, term: int = 0, count: int = 100, level: float | None = None) -> pd.DataFrame | None:
        if isinstance(self.model, GlmModel):
            return self.model.partial_effect(term, count, level)
        return self.model.terms[term].partial_effect(count) if isinstance(self.model, AdditiveModel) else None

    def contour(self, x: int, y: int, baseline, x_count=50, y_count=50) -> pd.DataFrame | None:
        return self.model.contour(x, y, baseline, x_count, y_count) if isinstance(self.model, GlmModel) else None


def fit(data: DataFrame, features: list[str], response: str, spec: ModelSpec = ModelSpec(), row_id: str | None = None, most_rows: int = MOST_ROWS, concurrent: bool = False) -> FittedModel | None:
    """Fit a specification to the finite rows of data; None if it cannot be fitted or does not converge.

    Local and additive smoothers hold their rows (at most most_rows, an error beyond); with `concurrent` the passes of the
    automatic smoothers over them run as tasks. The likelihood models never collect any.
    """
    ship_package(data.sparkSession)
    if not spec.valid:
        return None
    if spec.strategy in ("automaticSmoothing", "additiveGaussian"):
        held = training_arrays(data, features, response, row_id, drop_missing=True, most_rows=most_rows)
        return None if held is None else fit_arrays(*held, features, response, spec, in_tasks(data.sparkSession) if concurrent else whole)
    numbers = data.select(*[as_number(data, c).alias(c) for c in [*features, response]])
    result = fit_glm(finite_rows(numbers, [*features, response]), features, response, spec.family, spec.glm)
    return FittedModel(result.model, spec, features, response, result=result) if result.converged else None


def fit_arrays(x, y, row_ids, features, response, spec: ModelSpec, each=whole) -> FittedModel | None:
    """The same for the smoothers, from arrays."""
    if spec.strategy == "automaticSmoothing":
        found = fit_automatic(x, y, spec.degree, spec.spans or SPANS, spec.robust_iterations, spec.adaptive, row_ids, each)
        return None if found is None else FittedModel(found[0], spec, features, response, tuning=found[1])
    model = AdditiveModel.fit(x, y, spec.additive, row_ids=row_ids)
    return None if model is None else FittedModel(model, spec, features, response)
