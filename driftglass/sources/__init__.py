"""Binding DataFrames to fits."""
