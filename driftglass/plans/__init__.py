"""Fitting, evaluation, validation and the query catalogue."""
