"""Bind DataFrames to fits: finite rows, row ids, bounded training arrays, ranges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import with_ranks

#: Rows that a local smoother may hold, unless a caller raises it: its model is sent to every worker.
MOST_ROWS = 200_000


def finite(column: str | Column) -> Column:
    """Neither null, NaN nor infinite (in Spark NaN compares as larger than infinity, so all three are asked)."""
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def finite_rows(data: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that are finite in all columns, predictors without a term included; other columns stay."""
    condition = F.lit(True)
    for c in columns:
        condition = condition & finite(c)
    return data.filter(condition)


def as_number(data: DataFrame, column: str) -> Column:
    """A column as doubles: dates and timestamps as days since 1970."""
    kind = data.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(column).cast("timestamp")) / 86_400_000_000.0
    return F.datediff(F.col(column), F.lit("1970-01-01").cast("date")).cast("double") if isinstance(kind, T.DateType) else F.col(column).cast("double")


def with_row_ids(data: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Contiguous row ids from 0 in the given order."""
    return with_ranks(data, order, name)


def levels(data: DataFrame, column: str) -> DataFrame:
    """(level, code): integer codes of a text factor in its order, to be kept with the model."""
    return data.select(F.col(column).alias("level")).filter("level is not null").distinct().withColumn("code", F.row_number().over(Window.orderBy("level")) - 1)


def encode(data: DataFrame, column: str, table: DataFrame, into: str) -> DataFrame:
    """Add the code of each row's level, null for levels that the table does not know."""
    known = table.select(F.col("level").alias("__level"), F.col("code").cast("double").alias(into))
    return data.join(known, F.col(column) == F.col("__level"), "left").drop("__level")


def training_arrays(data: DataFrame, features: list[str], response: str, row_id: str | None = None, drop_missing: bool = False,
                    most_rows: int = MOST_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(x, y, row ids) in row-id order, or None if a row is not finite (with drop_missing such rows are left out).

    More than most_rows rows are an error: bin them first (see bin_rows), nothing is binned silently.
    """
    columns = [as_number(data, c).alias(f"__{k}") for k, c in enumerate([*features, response])]
    rows = data.select(*columns, (F.col(row_id) if row_id else F.lit(None)).alias("__row"))
    names = [f"__{k}" for k in range(len(features) + 1)]
    if drop_missing:
        rows = finite_rows(rows, names)
    held = rows.limit(most_rows + 1).toPandas()
    if len(held) > most_rows:
        raise ValueError(f"a local smoother holds at most {most_rows} rows; bin the rows first")
    if row_id:
        held = held.sort_values("__row", kind="stable")
    values = held[names].to_numpy(float)
    if not len(values) or not np.isfinite(values).all():
        return None
    return values[:, :-1], values[:, -1], held["__row"].to_numpy() if row_id else np.arange(len(held))


def bin_rows(data: DataFrame, feature: str, response: str, width: float) -> DataFrame:
    """(bin, x, y, n): means of feature and response in bins of a width, summed where the rows are."""
    x = as_number(data, feature)
    rows = data.select(x.alias("x"), F.col(response).cast("double").alias("y"))
    return finite_rows(rows, ["x", "y"]).groupBy(F.floor(F.col("x") / F.lit(width)).alias("bin")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))


def bounding_box(data: DataFrame, features: list[str]) -> list[tuple[float, float]]:
    """(min, max) of each feature, in one pass."""
    row = data.agg(*[f(as_number(data, c)) for c in features for f in (F.min, F.max)]).head()
    return [(row[2 * k], row[2 * k + 1]) for k in range(len(features))]


def in_box(features: list[str], box: list[tuple[float, float]]) -> Column:
    """Whether no feature is beyond the box, whose ends count as inside. NaN and null are beyond nothing."""
    inside = F.lit(True)
    for c, (low, high) in zip(features, box):
        value = F.col(c).cast("double")
        inside = inside & (value.isNull() | F.isnan(value) | value.between(low, high))
    return inside


def response_family(data: DataFrame, response: str) -> str:
    """binomial, poisson or gaussian by all finite responses, in one pass."""
    y = F.col(response).cast("double")
    binary, counts = finite_rows(data, [response]).agg(F.bool_and(y.isin(0.0, 1.0)), F.bool_and((y >= 0) & (y == F.floor(y)))).head()
    return "binomial" if binary else "poisson" if counts else "gaussian"
