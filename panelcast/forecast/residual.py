"""Boosted correction of the residuals: one set of trees for every series, on standardised lags."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.forecast.batches import map_series, series_starts
from panelcast.forecast.series_trees import Trees, fit_trees
from panelcast.operators.features import sliding_windows
from panelcast.operators.scaling import standardise_windows
from panelcast.spec import SeriesSpec

# Lags, least windows per series, and booster settings.
RESIDUAL_LAGS = 10
LEAST_WINDOWS = 5
SERIES_AT_ONCE = 256  # series that a task rolls forward together
BOOSTER = {"rounds": 100, "rate": 0.05, "depth": 5}

_TREES = [
    T.StructField("feature", T.BinaryType()), T.StructField("threshold", T.BinaryType()), T.StructField("value", T.BinaryType()),
    T.StructField("base", T.DoubleType()), T.StructField("rounds", T.IntegerType()),
]


def residual_windows(resid: DataFrame, spec: SeriesSpec, lags: int = RESIDUAL_LAGS) -> DataFrame:
    """Lag matrix of the residuals with its per-series means and deviations."""
    windows = sliding_windows(resid, spec, lags, value="resid")
    enough = windows.withColumn("n_windows", F.count(F.lit(1)).over(spec.series()))
    return standardise_windows(enough.where(F.col("n_windows") >= LEAST_WINDOWS), spec, lags)


def lag_scalers(windows: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Mean and deviation per lag position, one row per trained series."""
    return windows.groupBy(*spec.keys).agg(
        F.any_value("lag_mean").alias("lag_mean"), F.any_value("lag_std").alias("lag_std")
    )


def fit_boosters(windows: DataFrame, spec: SeriesSpec, overrides: dict | None = None) -> DataFrame:
    """One row of trees for every series of ``residual_windows``, many series grown at once in a task."""
    keys, options = list(spec.keys), {**BOOSTER, **(overrides or {})}
    schema = T.StructType([windows.schema[k] for k in keys] + _TREES)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        starts = series_starts(rows, keys)
        series = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
        trees = fit_trees(series, np.stack(rows["window_std"].to_numpy()), rows["target"].to_numpy(float), len(starts), **options)
        out = rows.iloc[starts][keys].reset_index(drop=True)
        return out.assign(
            feature=[a.tobytes() for a in trees.feature], threshold=[a.tobytes() for a in trees.threshold],
            value=[a.tobytes() for a in trees.value], base=trees.base, rounds=np.int32(options["rounds"]))

    return map_series(windows.select(*keys, spec.date, "window_std", "target"), keys, [spec.date], fit, schema)


def _stacked(rows: pd.DataFrame) -> Trees:
    """The trees of several series, whose settings are the same."""
    rounds = int(rows["rounds"].iloc[0])

    def stack(name, kind):
        return np.stack([np.frombuffer(raw, kind).reshape(rounds, -1) for raw in rows[name]])

    return Trees(stack("feature", np.int8), stack("threshold", float), stack("value", float), rows["base"].to_numpy())


def corrected(windows: DataFrame, boosters: DataFrame, spec: SeriesSpec) -> DataFrame:
    """In-sample correction of every residual window."""
    keys = list(spec.keys)
    schema = T.StructType([windows.schema[k] for k in keys] + [
        windows.schema[spec.date], T.StructField("resid", T.DoubleType()), T.StructField("correction", T.DoubleType())])

    def predict(key, rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out = rows[[*keys, spec.date]].assign(resid=rows["target"].to_numpy(float), correction=np.nan)
        if len(rows) and len(trees):
            x = np.stack(rows["window_std"].to_numpy())
            out["correction"] = _stacked(trees).predict(np.zeros(len(x), np.int64), x)
        return out

    return windows.select(*keys, spec.date, "window_std", "target").groupBy(*keys).cogroup(
        boosters.groupBy(*keys)).applyInPandas(predict, schema)


def corrections(
    boosters: DataFrame, params: DataFrame, scalers: DataFrame, spec: SeriesSpec, steps: int | Column, lags: int = RESIDUAL_LAGS
) -> DataFrame:
    """Recursive residual corrections per series and step; all series of an Arrow batch take a step together.

    Series whose residuals are too few for trees are absent and count as zero when added.
    """
    keys = list(spec.keys)
    until = F.lit(steps) if isinstance(steps, int) else steps
    state = params.where((F.col("status") == "fitted") & (F.size("resid") >= lags)).select(
        *keys, F.slice("resid", -lags, lags).alias("window"), until.cast("int").alias("steps"),
    ).join(scalers, keys).join(boosters, keys)
    schema = T.StructType([params.schema[k] for k in keys] + [
        T.StructField("step", T.IntegerType()), T.StructField("correction", T.DoubleType())])

    def roll(rows: pd.DataFrame) -> pd.DataFrame:
        trees = _stacked(rows)
        mean, deviation, window = (np.stack(rows[c].to_numpy()) for c in ("lag_mean", "lag_std", "window"))
        deviation = np.where(deviation > 0, deviation, 1.0)
        steps, series = rows["steps"].to_numpy(), np.arange(len(rows))
        parts = []
        for step in range(1, int(steps.max(initial=0)) + 1):
            y = trees.predict(series, (window - mean) / deviation)
            window = np.concatenate([window[:, 1:], y[:, None]], 1)
            parts.append(rows[keys].assign(step=np.int32(step), correction=y)[steps >= step])
        return pd.concat(parts) if parts else rows[keys].iloc[:0].assign(step=np.int32(0), correction=0.0)

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), SERIES_AT_ONCE):
                yield roll(frame.iloc[at:at + SERIES_AT_ONCE].reset_index(drop=True))

    return state.mapInPandas(run, schema)
