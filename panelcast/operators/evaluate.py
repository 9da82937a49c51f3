"""Error metrics, model comparison and run analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# Fixed value: keeps the percentage error finite at zero demand.
EPSILON = 1e-8

METRIC_COLUMNS = {"RMSE": "rmse", "MAE": "mae", "MAPE": "mape", "MAPE (%)": "mape"}


def error_metrics(backtest: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """MAE, RMSE, MAPE in percent and sample size per model (and any further grouping).

    ``backtest`` holds the actual ``y`` and the prediction ``yhat`` in one row per date.
    """
    error = F.col("y") - F.col("yhat")
    return backtest.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(F.abs(error / (F.abs("y") + EPSILON))) * 100).alias("mape"),
        F.count(F.lit(1)).alias("n_samples"),
    )


def metric_column(metric: str) -> str:
    """Unknown names fall back to RMSE."""
    return METRIC_COLUMNS.get(metric, "rmse")


def compare_models(metrics: DataFrame, metric: str = "RMSE", decimals: int | None = None) -> DataFrame:
    """Metrics table, best model first. One row per model, so the ranking window is tiny."""
    column = metric_column(metric)
    ranked = metrics.withColumn("rank", F.row_number().over(Window.orderBy(column, "model")))
    if decimals is not None:
        ranked = ranked.withColumns({c: F.bround(c, decimals) for c in ("mae", "rmse", "mape")})
    return ranked.orderBy("rank")


def best_model(metrics: DataFrame, metric: str = "RMSE") -> DataFrame:
    """Best model and its improvement over the worst, in percent with one decimal."""
    column = metric_column(metric)
    ends = metrics.agg(
        F.min_by("model", F.struct(column, "model")).alias("best_model"),
        F.min(column).alias("best_value"), F.max(column).alias("worst_value"),
    )
    gain = (F.col("worst_value") - F.col("best_value")) / F.nullif(F.col("worst_value"), F.lit(0.0)) * 100
    return ends.select(
        "best_model", "best_value", "worst_value",
        F.bround(F.coalesce(gain, F.lit(0.0)), 1).alias("improvement_pct"),
    )


def require_models(metrics: DataFrame) -> None:
    if metrics.isEmpty():
        raise ValueError("no models to compare")


def require_complete(backtest: DataFrame, keys: Sequence[str]) -> None:
    """All models must be judged on the same rows."""
    sizes = backtest.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    if sizes.agg((F.min("n") != F.max("n")).alias("uneven")).first().uneven:
        raise ValueError("length mismatch: models were evaluated on different rows")


def choose_model(metrics: DataFrame, losses: DataFrame | None = None) -> str:
    """Lowest validation RMSE; without one the lowest recorded loss; else the ensemble."""
    row = metrics.where(F.col("rmse").isNotNull()).agg(F.min_by("model", F.struct("rmse", "model")).alias("m")).first()
    if row.m is None and losses is not None:
        row = losses.where(F.col("val_loss").isNotNull()).agg(F.min_by("model", F.struct("val_loss", "model")).alias("m")).first()
    return row.m or "Ensemble"


def mean_forecast(forecasts: DataFrame) -> DataFrame:
    """Mean over all series per model and step."""
    return forecasts.groupBy("model", "step").agg(F.avg("yhat").alias("mean_yhat"))


def forecast_summary(forecasts: DataFrame, model: str = "Ensemble") -> DataFrame:
    return forecasts.where(F.col("model") == model).agg(
        F.count(F.lit(1)).alias("n"), F.avg("yhat").alias("mean_yhat"),
        F.max("yhat").alias("max_yhat"), F.min("yhat").alias("min_yhat"),
    )


def run_analytics(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Models evaluated and trained, training time, and whether results are ready."""
    trained = runs.agg(F.count_distinct("model").alias("n"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("s"))
    return metrics.agg(F.count_distinct("model").alias("models_evaluated")).select(
        "models_evaluated",
        trained.select("n").scalar().alias("models_trained"),
        trained.select("s").scalar().alias("total_training_time"),
        (F.col("models_evaluated") > 0).alias("ready"),
    )


def latest_forecasts(log: DataFrame, actuals: DataFrame, spec: SeriesSpec, lead: int = 1) -> DataFrame:
    """Each actual with the newest forecast of each model made at least ``lead`` days before it.

    ``log`` has (keys, model, origin, date, yhat); several runs may forecast the same date. Both sides meet by series and
    date, and only then is the newest origin kept, so that no window over the log is needed.
    """
    on = [*spec.keys, spec.date]
    known = actuals.select(*on, F.col(spec.demand).alias("y")).where(F.col("y").isNotNull())
    made = log.withColumnRenamed("date", spec.date) if spec.date != "date" else log
    in_time = made.join(known, on).where(F.date_diff(F.col(spec.date), F.col("origin")) >= lead)
    return in_time.groupBy(*on, "model").agg(
        F.first("y").alias("y"), F.max("origin").alias("origin"), F.max_by("yhat", "origin").alias("yhat"))


def rolling_accuracy(log: DataFrame, actuals: DataFrame, spec: SeriesSpec, days: int = 30, lead: int = 1) -> DataFrame:
    """Accuracy of each model over the last ``days`` days up to each date, all series together.

    Columns: n (forecasts judged), mae, rmse, mape (percent, dates with an actual of zero left out), bias (mean of forecast
    minus actual) and tracking (bias over mae; beyond a few tenths the model drifts). Sums by model and date come first, so
    that the windows hold one row a day.
    """
    off = F.col("yhat") - F.col("y")
    daily = latest_forecasts(log, actuals, spec, lead).groupBy("model", F.col(spec.date).alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(off).alias("off"), F.sum(F.abs(off)).alias("far"), F.sum(off * off).alias("square"),
        F.sum(F.when(F.col("y") != 0, F.abs(off / F.col("y")))).alias("share"), F.count_if(F.col("y") != 0).alias("n_share"))
    day = F.unix_date("date")
    back = Window.partitionBy("model").orderBy(day).rangeBetween(1 - days, 0)
    sums = daily.select("model", "date", *[F.sum(c).over(back).alias(c) for c in ("n", "off", "far", "square", "share", "n_share")])
    return sums.select(
        "model", "date", "n", (F.col("far") / F.col("n")).alias("mae"), F.sqrt(F.col("square") / F.col("n")).alias("rmse"),
        F.when(F.col("n_share") > 0, F.col("share") / F.col("n_share") * 100).alias("mape"), (F.col("off") / F.col("n")).alias("bias"),
        F.when(F.col("far") > 0, F.col("off") / F.col("far")).alias("tracking"))
