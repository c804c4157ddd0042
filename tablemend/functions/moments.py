"""Aggregate expressions: bias-adjusted moments and correlation that tolerates constants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def adjusted_skew(x: Column) -> Column:
    """Bias-adjusted skewness G1 (Spark's own is the population g1); null below three values."""
    n = F.count(x).cast("double")
    return F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(x: Column) -> Column:
    """Bias-adjusted excess kurtosis G2; null below four values."""
    n = F.count(x).cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are present; null if either is constant there."""
    both = x.isNotNull() & y.isNotNull()
    u, v = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(u, v), F.stddev_samp(u) * F.stddev_samp(v))


def sketch_distinct(cell: Column) -> Column:
    """Distinct present values from a sketch with a relative error of about 1.6 %."""
    mark = F.when(cell.isNotNull(), F.xxhash64(cell))
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(mark, 12)), F.lit(0))
