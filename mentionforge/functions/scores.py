"""Ratios, F1 conventions, intervals and percentiles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def precision(tp: Column, fp: Column) -> Column:
    return F.try_divide(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return F.try_divide(tp, tp + fn)


def f1_counts(tp: Column, fp: Column, fn: Column) -> Column:
    """2tp / (2tp + fp + fn): zero without hits but with errors, null only when there is nothing at all."""
    return F.try_divide(2 * tp, 2 * tp + fp + fn)


def f1_legacy(p: Column, r: Column) -> Column:
    """Null when a side is null or their sum is zero."""
    return F.try_divide(2 * p * r, p + r)


def f1_linkage(p: Column, r: Column) -> Column:
    """Null when a side is null or zero."""
    return F.when((p > 0) & (r > 0), 2 * p * r / (p + r))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a share; null without trials."""
    p = F.try_divide(k, n)
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)), F.when(n > 0, F.least(F.lit(1.0), middle + half))


def geometric_mean(p: Column, floor: float = 1e-30) -> Column:
    """Aggregate: geometric mean of probabilities floored."""
    return F.exp(F.avg(F.log(F.greatest(p, F.lit(floor)))))
