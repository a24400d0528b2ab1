"""Scalar and table functions as DataFrame expressions."""

from .columns import bisquare, deviance, link_mean, loss, median_of, quadratic_form, residual, soft_threshold, tricube
from .folds import assign_folds, equal_frequency_bin, permutation
from .numbers import normal_quantile, percentile

__all__ = ["assign_folds", "bisquare", "deviance", "equal_frequency_bin", "link_mean", "loss", "median_of", "normal_quantile", "percentile",
           "permutation", "quadratic_form", "residual", "soft_threshold", "tricube"]
