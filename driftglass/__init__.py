"""Driftglass: local regression, additive models and sequence smoothing on Spark DataFrames."""

__version__ = "0.1.0"
