"""Evidence as JSON: validations, calibrations, comparisons, bootstraps and how a sparse system was solved.

A record holds its rows too, so it is for results of bounded size; more than `most_rows` rows are an error (write the
DataFrame itself then). Older records may lack fields that came later: those read as None, or as what was the only possibility then.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.binding import MOST_ROWS
from .model import ModelSpec
from .validation import Bootstrap, Comparison, Validation

_ROWS = {
    "predictions": "id long, fold int, observed double, predicted double",
    "folds": "id int, n long, rmse double, mae double, mean_deviance double",
    "losses": "id long, fold int, baseline_loss double, candidate_loss double, difference double",
    "bins": "id int, n long, min_p double, max_p double, mean_p double, observed_frequency double",
    "points": "id int, query array<double>, reference double, mean double, sd double, lo double, hi double",
}


def _rows(df: DataFrame | None, most_rows: int) -> list[dict] | None:
    if df is None:
        return None
    held = df.limit(most_rows + 1).collect()
    if len(held) > most_rows:
        raise ValueError(f"a record holds at most {most_rows} rows; write the table itself")
    return sorted((r.asDict() for r in held), key=lambda r: r["id"])


def _table(spark: SparkSession, told: dict, name: str) -> DataFrame | None:
    rows = told.get(name)
    names = [part.strip().split(" ")[0] for part in _ROWS[name].split(", ")]
    return None if rows is None else spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], _ROWS[name])


def validation_to_json(v: Validation, most_rows: int = MOST_ROWS) -> str:
    return json.dumps({"family": v.family, "spec": json.loads(v.spec.to_json()), "n": v.n, "overall": v.overall, "folds": _rows(v.folds, most_rows), "predictions": _rows(v.predictions, most_rows)})


def validation_from_json(spark: SparkSession, text: str) -> Validation:
    told = json.loads(text)
    return Validation(told["family"], ModelSpec.from_json(json.dumps(told["spec"])), _table(spark, told, "predictions"), _table(spark, told, "folds"), told["overall"], told["n"])


def calibration_to_json(found: tuple[DataFrame, dict], most_rows: int = MOST_ROWS) -> str:
    return json.dumps({"bins": _rows(found[0], most_rows), "summary": found[1]})


def calibration_from_json(spark: SparkSession, text: str) -> tuple[DataFrame, dict]:
    told = json.loads(text)
    return _table(spark, told, "bins"), told["summary"]


def comparison_to_json(c: Comparison, most_rows: int = MOST_ROWS) -> str:
    return json.dumps({"status": c.status, "summary": c.summary, "losses": _rows(c.losses, most_rows)})


def comparison_from_json(spark: SparkSession, text: str) -> Comparison:
    told = json.loads(text)
    return Comparison(told["status"], told.get("summary") or {}, _table(spark, told, "losses"))


def bootstrap_to_json(b: Bootstrap, most_rows: int = MOST_ROWS) -> str:
    return json.dumps({"status": b.status, "family": b.family, "attempted": b.attempted, "successful": b.successful, "points": _rows(b.predictions, most_rows)})


def bootstrap_from_json(spark: SparkSession, text: str) -> Bootstrap:
    told = json.loads(text)
    return Bootstrap(told["status"], told.get("family"), told.get("attempted", 0), told.get("successful", 0), _table(spark, told, "points"))


@dataclass(frozen=True)
class SparseEvidence:
    """How a sparse system was solved. Records from before limits and tolerances were told have None for these."""

    rows: int
    columns: int
    non_zero: int
    iterations: int
    residual: float
    converged: bool
    deviance: float
    penalty: float
    limit: int | None = None
    tolerance: float | None = None
    inference: str = "exactDenseCovariance"

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def from_json(cls, text: str) -> SparseEvidence:
        told = json.loads(text)
        return cls(**{k: told[k] for k in cls.__dataclass_fields__ if told.get(k) is not None})
