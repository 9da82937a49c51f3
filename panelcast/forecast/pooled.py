"""One regressor over the scaled lag windows of all series, and its recursive forecasts."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.forecast.network import SequenceNetwork, fit_network
from panelcast.forecast.recursion import roll_forward
from panelcast.operators.alignment import SEQUENCE
from panelcast.operators.scaling import scaled, unscaled
from panelcast.spec import SeriesSpec

# Fixed value: rounds without a better validation loss before boosting stops.
PATIENCE = 8


@dataclass
class TrainedModel:
    model: Model | SequenceNetwork
    seq: int
    seconds: float
    losses: list[float] = field(default_factory=list)  # training loss after each round
    val_losses: list[float] = field(default_factory=list)  # validation loss after each round; none for the linear model


def training_windows(windows: DataFrame, seq: int, validation_share: float = 0.1) -> DataFrame:
    """Training windows; the newest share of each series validates.

    Test windows take no part in fitting or in early stopping.
    """
    held = F.floor((F.col("split_idx") - seq) * F.lit(validation_share))
    return windows.where(~F.col("is_test")).select(
        "window", F.col("target").cast("double").alias("target"), (F.col("pos") >= F.col("split_idx") - held).alias("is_validation"))


def training_rows(windows: DataFrame, seq: int, validation_share: float = 0.1) -> DataFrame:
    """``training_windows`` as feature vectors."""
    return training_windows(windows, seq, validation_share).select(
        array_to_vector("window").alias("features"), F.col("target").alias("label"), "is_validation")


def first_trees(model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The model of the first boosting rounds, made of the trees that are already grown."""
    context = SparkContext._active_spark_context
    java, jvm = model._java_obj, context._jvm
    trees = context._gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = context._gateway.new_array(jvm.double, rounds)
    for i in range(rounds):
        trees[i], weights[i] = java.trees()[i], float(java.treeWeights()[i])
    prefix = jvm.org.apache.spark.ml.regression.GBTRegressionModel(java.uid(), trees, weights)
    out = GBTRegressionModel(prefix)
    model._copyValues(out)
    out._transfer_params_to_java()
    return out


def best_round(val_losses: list[float], patience: int = PATIENCE) -> tuple[int, int]:
    """Number of rounds with the lowest loss, and the number looked at before patience ran out."""
    best = 0
    for i, loss in enumerate(val_losses):
        if loss < val_losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, i + 1
    return best + 1, len(val_losses)


def fit_sequence_model(
    windows: DataFrame, seq: int, kind: str = "gbt", max_iter: int = 30, validation_share: float = 0.1, **overrides
) -> TrainedModel:
    """Distributed fit of boosted trees ("gbt"), of a linear model ("linear") or of a recurrent network ("network").

    The rounds or weights of the lowest validation loss are kept, looked for with patience; without validation rows all rounds
    of the trees are kept. ``max_iter`` counts boosting rounds or epochs.
    """
    if kind == "network":
        network, losses, val_losses, seconds = fit_network(
            training_windows(windows, seq, validation_share), seq, epochs=max_iter, **overrides)
        return TrainedModel(network, seq, seconds, losses, val_losses)
    rows = training_rows(windows, seq, validation_share).persist()
    started = time.perf_counter()
    val_losses: list[float] = []
    try:
        if kind == "linear":
            model = LinearRegression(**{"regParam": 1e-6, "elasticNetParam": 0.0, **overrides}).fit(rows)
            losses = [model.summary.meanSquaredError]
        else:
            options = {"maxIter": max_iter, "maxDepth": 5, "stepSize": 0.1, "seed": 42, **overrides}
            train, held = rows.where(~F.col("is_validation")), rows.where("is_validation")
            model = GBTRegressor(**options).fit(train)
            losses = list(model.evaluateEachIteration(train, "squared"))
            if not held.isEmpty():
                val_losses = list(model.evaluateEachIteration(held, "squared"))
                best, seen = best_round(val_losses)
                losses, val_losses = losses[:seen], val_losses[:seen]
                if best < len(model.trees):
                    model = first_trees(model, best)
        return TrainedModel(model, seq, time.perf_counter() - started, losses, val_losses)
    finally:
        rows.unpersist()


def predict_windows(trained: TrainedModel, windows: DataFrame, spec: SeriesSpec, date: str | None = None) -> DataFrame:
    """One-step prediction per window in the scale of its own series."""
    if isinstance(trained.model, SequenceNetwork):
        scored = trained.model.scored(windows)
    else:
        scored = trained.model.transform(windows.withColumn("features", array_to_vector("window")))
    return scored.select(
        *spec.keys, date or spec.date, F.lit(SEQUENCE).alias("model"),
        F.col("actual").alias("y"), unscaled(F.col("prediction")).alias("yhat"),
    )


def contexts(tails: DataFrame, scalers: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Last windows of each series, scaled with its own training range.

    A series without a stored range uses the range of its window.
    """
    joined = tails.join(scalers, list(spec.keys), "left").withColumns(
        {
            "min": F.coalesce("min", F.array_min("window")),
            "max": F.coalesce("max", F.array_max("window")),
        }
    )
    return joined.withColumn("window", F.transform("window", lambda v: scaled(v)))


def sequence_forecast(trained: TrainedModel, state: DataFrame, spec: SeriesSpec, steps: int | Column) -> DataFrame:
    """Recursive forecast of every context in the scale of its series.

    ``steps`` may be a column of ``state``, for a horizon of each series of its own.
    """
    if isinstance(trained.model, SequenceNetwork):
        rolled = trained.model.rolled(state, steps)
    else:
        rolled = roll_forward(trained.model, state, steps)
    return rolled.select(*spec.keys, "last_date", "min", "max", F.posexplode("path").alias("_i", "_v")).select(
        *spec.keys, F.lit(SEQUENCE).alias("model"), (F.col("_i") + 1).alias("step"),
        F.date_add(F.col("last_date").cast("date"), F.col("_i") + 1).alias("date"), unscaled(F.col("_v")).alias("yhat"),
    )
