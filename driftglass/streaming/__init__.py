"""Evaluate fitted models on streams (an addition: nothing here keeps state)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.model import FittedModel


def transform_stream(model: FittedModel, stream: DataFrame, **options) -> DataFrame:
    """A streaming DataFrame with fit (and se, grad, lo, hi on demand) for each arriving row."""
    if not stream.isStreaming:
        raise ValueError("not a streaming DataFrame")
    return model.transform(stream, **options)
