"""Fits whose passes over the rows run as tasks, and fits that can be called off.

A pass of a local smoother looks at every row's neighbourhood on its own, so blocks of rows are worked on side by side; what a pass
needs of the others (the training arrays, whose size is bounded, and the weights so far) goes with the task.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from ..shipping import ship_package


def in_tasks(spark: SparkSession, blocks: int | None = None):
    """An `each` for fits: each(function, n) gives function(rows 0 … n - 1), an array or a tuple of such, from tasks over blocks of rows."""
    ship_package(spark)

    def each(function, n: int):
        parts = min(n, blocks or 4 * spark.sparkContext.defaultParallelism)
        first = function(np.arange(1))
        several = isinstance(first, tuple)
        names = [f"v{k}" for k in range(len(first) if several else 1)]
        kinds = [np.asarray(v).dtype for v in (first if several else (first,))]

        def run(batches):
            for batch in batches:
                for k in batch["id"]:
                    rows = np.arange(n * k // parts, n * (k + 1) // parts)
                    told = function(rows)
                    yield pd.DataFrame({"row": rows} | {c: np.asarray(v, float).reshape(len(rows), -1).tolist() for c, v in zip(names, told if several else (told,))})

        table = spark.range(parts).repartition(parts, "id").mapInPandas(run, "row long, " + ", ".join(f"{c} array<double>" for c in names))
        held = table.toPandas().sort_values("row")
        shapes = [np.asarray(v).shape[1:] for v in (first if several else (first,))]
        out = tuple(np.array(held[c].tolist(), dtype=float).reshape(n, *shape).astype(kind) for c, shape, kind in zip(names, shapes, kinds))
        return out if several else out[0]

    return each


class Cancelled(Exception):
    """The work was called off."""


class Handle:
    """Calls off what runs under cancellable(); may be used from any thread."""

    def __init__(self, spark: SparkSession, group: str):
        self.spark, self.group, self.cancelled = spark, group, False

    def cancel(self) -> None:
        self.cancelled = True
        self.spark.sparkContext.cancelJobGroup(self.group)

    def check(self) -> None:
        """Raise Cancelled if the work was called off; for loops between jobs."""
        if self.cancelled:
            raise Cancelled(self.group)


@contextmanager
def cancellable(spark: SparkSession, name: str = "driftglass"):
    """Run jobs of this thread so that handle.cancel() stops them, interrupting their tasks; the block then ends with Cancelled."""
    context = spark.sparkContext
    handle = Handle(spark, f"{name}-{uuid.uuid4().hex}")
    context.setJobGroup(handle.group, name, interruptOnCancel=True)
    try:
        yield handle
        handle.check()
    except Exception as error:
        if handle.cancelled and not isinstance(error, Cancelled):
            raise Cancelled(handle.group) from error
        raise
    finally:
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(key, None)
