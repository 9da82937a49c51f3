"""Per-series scaling fitted on training rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.spec import SeriesSpec


def _span(low: Column, high: Column) -> Column:
    """Range of the training values; a constant series uses 1."""
    return F.when(high > low, high - low).otherwise(F.lit(1.0))


def fit_minmax(df: DataFrame, spec: SeriesSpec, train: Column | None = None) -> DataFrame:
    """Scaler table: least and greatest training value per series."""
    value = F.col(spec.demand) if train is None else F.when(train, F.col(spec.demand))
    return df.groupBy(*spec.keys).agg(F.min(value).alias("min"), F.max(value).alias("max"))


def minmax_columns(df: DataFrame, spec: SeriesSpec, train: Column) -> DataFrame:
    """Attach the training range to every row through a window instead of a join."""
    value = F.when(train, F.col(spec.demand))
    return df.withColumns(
        {"min": F.min(value).over(spec.series()), "max": F.max(value).over(spec.series())}
    )


def scaled(value: Column, low: Column | None = None, high: Column | None = None) -> Column:
    low = F.col("min") if low is None else low
    high = F.col("max") if high is None else high
    return (value - low) / _span(low, high)


def unscaled(value: Column, low: Column | None = None, high: Column | None = None) -> Column:
    low = F.col("min") if low is None else low
    high = F.col("max") if high is None else high
    return value * _span(low, high) + low


def look_up_scalers(df: DataFrame, scalers: DataFrame, spec: SeriesSpec, default: tuple[float, float]) -> DataFrame:
    """Join the scaler of each series; series without one use the default range."""
    return df.join(scalers, list(spec.keys), "left").withColumns(
        {
            "min": F.coalesce("min", F.lit(float(default[0]))),
            "max": F.coalesce("max", F.lit(float(default[1]))),
        }
    )


def standardise_windows(windows: DataFrame, spec: SeriesSpec, size: int, column: str = "window") -> DataFrame:
    """Standardise every lag position of a series with its population mean and deviation."""
    over = spec.series()
    stats = {}
    for i in range(size):
        lag = F.col(column)[i]
        stats[f"_m{i}"] = F.avg(lag).over(over)
        stats[f"_s{i}"] = F.stddev_pop(lag).over(over)
    means = F.array(*[F.col(f"_m{i}") for i in range(size)])
    devs = F.array(*[F.col(f"_s{i}") for i in range(size)])
    return (
        windows.withColumns(stats)
        .withColumns({"lag_mean": means, "lag_std": devs})
        .drop(*stats)
        .withColumn(column + "_std", standardised(F.col(column)))
    )


def standardised(window: Column) -> Column:
    """(value - mean) / deviation per position; a constant position divides by 1."""
    centred = F.zip_with(window, F.col("lag_mean"), lambda v, m: v - m)
    return F.zip_with(
        centred, F.col("lag_std"), lambda v, s: v / F.when(s > 0, s).otherwise(F.lit(1.0))
    )
