"""The hybrid forecaster as a Spark ML estimator: fitted, stored and loaded like any other stage."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import DataFrame

from panelcast.forecast.hybrid import HybridModel, fit_hybrid, hybrid_forecast
from panelcast.spec import SeriesSpec


class _HybridParams(Params):
    keys = Param(Params._dummy(), "keys", "columns that name a series", TypeConverters.toListString)
    dateCol = Param(Params._dummy(), "dateCol", "date column", TypeConverters.toString)
    demandCol = Param(Params._dummy(), "demandCol", "demand column", TypeConverters.toString)
    order = Param(Params._dummy(), "order", "(p, d, q) tried first", TypeConverters.toListInt)
    minRows = Param(Params._dummy(), "minRows", "least rows of a series", TypeConverters.toInt)
    rounds = Param(Params._dummy(), "rounds", "boosting rounds of the residual trees", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(keys=["store_id", "sku_id"], dateCol="date", demandCol="units_sold", order=[1, 1, 1], minRows=20, rounds=100)

    def spec(self) -> SeriesSpec:
        return SeriesSpec(
            self.getOrDefault("dateCol"), self.getOrDefault("demandCol"), tuple(self.getOrDefault("keys")))


class HybridForecaster(Estimator, _HybridParams, DefaultParamsReadable, DefaultParamsWritable):
    """ARIMA with boosted residual corrections for every series of a clean panel."""

    @keyword_only
    def __init__(self, *, keys=None, dateCol=None, demandCol=None, order=None, minRows=None, rounds=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> HybridForecast:
        fitted = fit_hybrid(
            dataset, self.spec(), tuple(self.getOrDefault("order")), self.getOrDefault("minRows"),
            {"rounds": self.getOrDefault("rounds")})
        return self._copyValues(HybridForecast(fitted))


class _Writer(MLWriter):
    def __init__(self, instance: HybridForecast):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        fitted = self.instance.fitted
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"seconds": fitted.seconds})
        for name in ("params", "scalers", "boosters"):
            getattr(fitted, name).write.parquet(f"{path}/{name}")


class _Reader(MLReader):
    def load(self, path: str) -> HybridForecast:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        parts = [self.sparkSession.read.parquet(f"{path}/{name}") for name in ("params", "scalers", "boosters")]
        model = HybridForecast(HybridModel(*parts, metadata["seconds"]))
        DefaultParamsReader.getAndSetParams(model, metadata)
        model._resetUid(metadata["uid"])
        return model


class HybridForecast(Model, _HybridParams, MLWritable, MLReadable):
    """Fitted parameters, lag scalers and trees of all series."""

    def __init__(self, fitted: HybridModel):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Forecasts (keys, model, step, date, yhat) of the series in ``dataset``, whose column ``horizon`` says how far."""
        return hybrid_forecast(self.fitted, self.spec(), horizon=dataset)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()

