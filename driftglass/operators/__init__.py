"""Estimators and their kernels."""
