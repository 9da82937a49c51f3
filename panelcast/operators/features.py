"""Lag, rolling and sliding-window features, always inside one series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.spec import SeriesSpec


def lag_features(
    df: DataFrame,
    spec: SeriesSpec,
    lags: Sequence[int] = (1, 7, 14, 30),
    drop_incomplete: bool = True,
) -> DataFrame:
    order = spec.ordered()
    out = df.withColumns({f"Sales_Lag_{k}": F.lag(spec.demand, k).over(order) for k in lags})
    return out.dropna() if drop_incomplete else out


def rolling_features(
    df: DataFrame, spec: SeriesSpec, windows: Sequence[int] = (7, 14, 30)
) -> DataFrame:
    """Mean and deviation over the last w rows, current row included; a lone row deviates by 0."""
    columns = {}
    for w in windows:
        frame = spec.ordered().rowsBetween(1 - w, 0)
        columns[f"Rolling_Mean_{w}"] = F.avg(spec.demand).over(frame)
        columns[f"Rolling_Std_{w}"] = F.coalesce(F.stddev_samp(spec.demand).over(frame), F.lit(0.0))
    return df.withColumns(columns)


def moving_averages(df: DataFrame, spec: SeriesSpec, window: int = 30) -> DataFrame:
    long_window = max(3 * window, window + 1)
    return df.withColumns(
        {
            "MA_Short": F.avg(spec.demand).over(spec.ordered().rowsBetween(1 - window, 0)),
            "MA_Long": F.avg(spec.demand).over(spec.ordered().rowsBetween(1 - long_window, 0)),
        }
    )


def sliding_windows(df: DataFrame, spec: SeriesSpec, size: int, value: str | None = None) -> DataFrame:
    """Each row with its ``size`` predecessors as ``window``; rows lacking them are left out."""
    value = value or spec.demand
    before = spec.ordered().rowsBetween(-size, -1)
    return (
        df.withColumn("window", F.transform(  # structs keep missing values, which a plain list would leave out
            F.collect_list(F.struct(F.col(value).alias("v"))).over(before), lambda x: x["v"]))
        .where(F.size("window") == size)
        .withColumnRenamed(value, "target")
    )


def tail_windows(df: DataFrame, spec: SeriesSpec, size: int, pad: bool = True) -> DataFrame:
    """The last ``size`` values of every series as one array, oldest first.

    A shorter history is padded on the left with its mean, or left out when ``pad`` is off.
    Only ``size`` rows per series reach the collecting step.
    """
    newest_first = spec.series().orderBy(F.col(spec.date).desc())
    recent = df.withColumn("_back", F.row_number().over(newest_first)).where(F.col("_back") <= size)
    gathered = recent.groupBy(*spec.keys).agg(
        F.max(spec.date).alias("last_date"),
        F.avg(spec.demand).alias("_mean"),
        F.sort_array(F.collect_list(F.struct("_back", spec.demand)), asc=False).alias("_pairs"),
    )
    values = F.transform("_pairs", lambda p: p[spec.demand])
    missing = F.lit(size) - F.size("_pairs")
    if not pad:
        gathered = gathered.where(F.size("_pairs") == size)
    return gathered.select(
        *spec.keys,
        "last_date",
        F.size("_pairs").alias("n_history"),
        F.concat(F.array_repeat(F.col("_mean"), missing), values).alias("window"),
    )


def last_rows(df: DataFrame, spec: SeriesSpec, n: int = 90) -> DataFrame:
    """The newest ``n`` rows of each series."""
    newest_first = spec.series().orderBy(F.col(spec.date).desc())
    return df.withColumn("_back", F.row_number().over(newest_first)).where(F.col("_back") <= n).drop("_back")
