"""ARIMA plus boosted residual correction for every series of a panel."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.forecast import arima
from panelcast.forecast.residual import corrections, fit_boosters, lag_scalers, residual_windows
from panelcast.operators.alignment import HYBRID
from panelcast.session import written
from panelcast.spec import SeriesSpec


@dataclass
class HybridModel:
    params: DataFrame
    scalers: DataFrame
    boosters: DataFrame
    seconds: float


def fit_hybrid(
    train: DataFrame, spec: SeriesSpec, order: arima.Order = (1, 1, 1), min_rows: int = 20, booster: dict | None = None
) -> HybridModel:
    """Fit all series; raises only when none could be fitted.

    The parameter table is stored once, as residuals, booster and forecasts all read it.
    """
    started = time.perf_counter()
    params = written(arima.fit_arima(train, spec, order, min_rows), "arima_params")
    fitted = params.agg(F.count_if(F.col("status") == "fitted").alias("n"), F.count(F.lit(1)).alias("all")).first()
    if fitted.n == 0:
        raise RuntimeError(f"fitting failed for all {fitted.all} series; check length and finite values")
    windows = written(residual_windows(arima.residuals(params, spec), spec), "residual_windows")
    scalers = written(lag_scalers(windows, spec), "lag_scalers")
    boosters = written(fit_boosters(windows, spec, booster), "boosters")
    return HybridModel(params, scalers, boosters, time.perf_counter() - started)


def hybrid_forecast(model: HybridModel, spec: SeriesSpec, steps: int | None = None, horizon: DataFrame | None = None) -> DataFrame:
    """Sum of both parts per series and step, for ``steps`` or for the column ``horizon`` of each series."""
    params = model.params
    if horizon is not None:
        params = params.join(horizon.select(*spec.keys, "horizon"), list(spec.keys))
    base = arima.arima_forecast(params, spec, steps, "horizon" if horizon is not None else None)
    until = steps if horizon is None else F.col("horizon")
    added = corrections(model.boosters, params, model.scalers, spec, until)
    return base.join(added, [*spec.keys, "step"], "left").select(
        *spec.keys, F.lit(HYBRID).alias("model"), "step", "date",
        (F.col("yhat") + F.coalesce("correction", F.lit(0.0))).alias("yhat"),
    )
