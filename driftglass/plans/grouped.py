"""One curve per group: many small fits side by side, each group in one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from ..sources.binding import MOST_ROWS, as_number, finite_rows


def fit_groups(data: DataFrame, keys: list[str], feature: str, response: str, row_id: str, fit, most_rows: int = MOST_ROWS) -> DataFrame:
    """(keys, row_id, x, y, fit, se) for each finite row: fit(x, y) is called for every group and gives a model or None (null fits).

    A group is a curve and is held whole, so one of more than most_rows rows is an error before any fitting starts: bin it
    first (sources.bin_rows).
    """
    ship_package(data.sparkSession)
    rows = data.select(*keys, row_id, as_number(data, feature).alias("x"), F.col(response).cast("double").alias("y"))
    rows = finite_rows(rows, ["x", "y"])
    largest = rows.groupBy(*keys).count().agg(F.max("count")).head()[0]
    if largest is not None and largest > most_rows:
        raise ValueError(f"a curve of {largest} rows; bin curves of more than {most_rows} rows first")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys, row_id).schema) + ", x double, y double, fit double, se double"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(row_id, kind="stable").reset_index(drop=True)
        model = fit(frame[["x"]].to_numpy(), frame["y"].to_numpy())
        frame["fit"] = np.nan if model is None else model.fitted
        frame["se"] = np.nan if model is None else (model.errors if getattr(model, "errors", None) is not None else model.standard_error(frame[["x"]].to_numpy()))
        return frame[[*keys, row_id, "x", "y", "fit", "se"]]

    return rows.groupBy(*keys).applyInPandas(run, schema)
