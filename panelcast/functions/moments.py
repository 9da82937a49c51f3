"""Aggregates that Spark only offers in population form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(value: Column) -> Column:
    """Bias-corrected skewness; NULL below three values."""
    n = F.count(value).cast("double")
    factor = F.when(n >= 3, F.sqrt(n * (n - 1)) / (n - 2))
    return factor * F.skewness(value)


def sample_kurtosis(value: Column) -> Column:
    """Bias-corrected excess kurtosis; NULL below four values."""
    n = F.count(value).cast("double")
    factor = F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)))
    return factor * ((n + 1) * F.kurtosis(value) + 6.0)


def sample_std(value: Column) -> Column:
    """Standard deviation with n-1; 0 when there is at most one value."""
    return F.coalesce(F.stddev_samp(value), F.lit(0.0))
