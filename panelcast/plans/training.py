"""Whole flows: train and back-test both models, forecast the future, fill a submission."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.forecast.hybrid import HybridModel, fit_hybrid, hybrid_forecast
from panelcast.forecast.pooled import TrainedModel, contexts, fit_sequence_model, predict_windows, sequence_forecast
from panelcast.inventory.policy import recommendations, require_params
from panelcast.operators.alignment import (
    HYBRID, SEQUENCE, align_actuals, attach_forecasts, ensemble, past_the_gap, select_predictions, side_by_side,
)
from panelcast.operators.evaluate import choose_model, error_metrics, require_complete, require_models
from panelcast.operators.features import tail_windows
from panelcast.operators.scaling import fit_minmax
from panelcast.operators.splits import hybrid_rule, sequence_rule, series_status, split_series, split_windows
from panelcast.plans.store import RunStore
from panelcast.session import written
from panelcast.spec import InventoryParams, SeriesSpec


@dataclass
class Trained:
    clean: DataFrame
    sequence: TrainedModel
    hybrid: HybridModel
    scalers: DataFrame
    fitted_rows: DataFrame
    backtest: DataFrame
    metrics: DataFrame
    status: DataFrame
    runs: DataFrame
    seq: int


def train_and_backtest(
    clean: DataFrame, spec: SeriesSpec, seq: int = 30, test_size: float = 0.2,
    order: tuple[int, int, int] = (1, 1, 1), kind: str = "gbt", max_iter: int = 30, booster: dict | None = None,
    store: RunStore | None = None, run_id: str | None = None, version: str | None = None,
) -> Trained:
    """Train on the earlier part of each series and judge both models on the same later dates.

    A single series takes part as a panel of one; see ``panelcast.spec.keyed``. With ``store`` the run and its metrics are
    recorded under ``run_id``; the metrics' version is the run's id unless one is given.
    """
    run_id = run_id or uuid.uuid4().hex
    clean = written(clean, "clean")  # read by windows, split, alignment, scalers, status and later forecasts
    rule = sequence_rule(seq, test_size)
    windows = split_windows(clean, spec, seq, rule).persist()
    try:
        sequence = fit_sequence_model(windows, seq, kind, max_iter)
        tested = written(predict_windows(sequence, windows.where("is_test"), spec), "sequence_backtest")
    finally:
        windows.unpersist()
    parts = written(split_series(clean, spec, hybrid_rule(test_size)), "hybrid_split")
    train = parts.where(~F.col("is_test"))
    hybrid = fit_hybrid(train, spec, order, booster=booster)
    held = parts.where("is_test")
    horizon = held.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("horizon"))
    # Test rows are matched by their position past the split, so gaps in the calendar do not shift dates.
    ahead = hybrid_forecast(hybrid, spec, horizon=horizon)
    hybrid_test = attach_forecasts(held, ahead, spec).where(F.col("yhat").isNotNull()).select(
        *spec.keys, spec.date, F.lit(HYBRID).alias("model"), F.col(spec.demand).alias("y"), "yhat"
    )
    sequence_test = tested.select(*spec.keys, spec.date, "model", "y", "yhat")
    on = [*spec.keys, spec.date]
    shared = ensemble(sequence_test, hybrid_test, on)
    both = sequence_test.select(*on).join(hybrid_test.select(*on), on)
    backtest = written(
        align_actuals(clean, shared, spec).join(both, on, "left_semi"), "backtest"
    )
    runs = clean.sparkSession.createDataFrame(
        [("Sequence", sequence.seconds, sequence.losses, sequence.val_losses), ("Hybrid", hybrid.seconds, [], [])],
        "model string, seconds double, losses array<double>, val_losses array<double>",
    )
    metrics = error_metrics(backtest)
    scaler_rows = split_series(clean, spec, rule)
    scalers = fit_minmax(scaler_rows, spec, ~F.col("is_test"))
    require_models(metrics)
    require_complete(backtest, spec.keys)
    trained = Trained(clean, sequence, hybrid, scalers, train, backtest, metrics, series_status(clean, spec, rule, seq), runs, seq)
    if store:
        store.record_training(trained, spec, run_id, version or run_id)
    return trained


def future_forecast(
    trained: Trained, clean: DataFrame, spec: SeriesSpec, steps: int, store: RunStore | None = None, run_id: str | None = None,
) -> DataFrame:
    """Both models and their mean for the next ``steps`` days; a missing model is replaced by the other.

    With ``store`` the forecasts are recorded under ``run_id`` and read back from there.
    """
    on = [*spec.keys, "step"]
    state = contexts(tail_windows(clean, spec, trained.seq, pad=False), trained.scalers, spec)
    sequence = sequence_forecast(trained.sequence, state, spec, steps)
    gaps = _gaps(clean, trained, spec).withColumn("n_test", F.lit(steps))
    hybrid = _hybrid_past_gap(trained.hybrid, gaps, spec)
    last = clean.groupBy(*spec.keys).agg(F.max(spec.date).cast("date").alias("_last"))
    long = ensemble(sequence, hybrid, on)
    dated = long.join(last, list(spec.keys)).select(
        *spec.keys, "model", "step", F.date_add("_last", F.col("step")).alias("date"), "yhat"
    )
    if not store:
        return dated
    run_id = run_id or uuid.uuid4().hex
    store.record_forecasts(dated, run_id, spec, F.date_sub("date", F.col("step")))
    return store.table("forecasts").where(F.col("run_id") == run_id).select(dated.columns)


def generate_submission(
    trained: Trained, clean: DataFrame, test: DataFrame, spec: SeriesSpec, record_id: str = "record_ID", model: str | None = None,
) -> DataFrame:
    """``(record_id, units_sold)`` for every test row, from the best or the requested model.

    Each series continues from the end of its own history. A series that cannot be predicted
    raises an error instead of getting made-up values.
    """
    losses = trained.runs.select("model", F.array_min("val_losses").alias("val_loss"))
    selected = model or choose_model(trained.metrics.where(F.col("model").isin(SEQUENCE, HYBRID)), losses)
    needs = test.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n_test"))
    asked = tail_windows(clean, spec, trained.seq, pad=True).join(needs, list(spec.keys))
    state = contexts(asked, trained.scalers, spec)
    on = [*spec.keys, "step"]
    sequence = sequence_forecast(trained.sequence, state, spec, F.col("n_test"))
    gaps = _gaps(clean, trained, spec).join(needs, list(spec.keys))
    hybrid = _hybrid_past_gap(trained.hybrid, gaps, spec)
    chosen = select_predictions(side_by_side(sequence, hybrid, on, ("sequence", "hybrid")), selected)
    filled = attach_forecasts(test, chosen, spec)
    return finish_submission(written(filled, "submission"), spec, record_id, test)


def stock_plan(
    clean: DataFrame, spec: SeriesSpec, params: InventoryParams | DataFrame | None = None, forecasts: DataFrame | None = None,
    store: RunStore | None = None, run_id: str | None = None,
) -> DataFrame:
    """Replenishment rows from checked parameters; with ``store`` recorded under ``run_id`` and read back from there."""
    if isinstance(params, DataFrame):
        require_params(params)
    plan = recommendations(clean, spec, params, forecasts)
    if not store:
        return plan
    run_id = run_id or uuid.uuid4().hex
    store.record_analysis(plan, run_id)
    return store.table("analyses").where(F.col("run_id") == run_id).select(plan.columns)


def finish_submission(
    filled: DataFrame, spec: SeriesSpec, record_id: str = "record_ID", template: DataFrame | None = None
) -> DataFrame:
    """Clip at zero and order; raise when a series has rows without a prediction, or records differ from the template's."""
    require_complete_submission(filled, spec)
    if template is not None:
        require_template(filled, template, record_id)
    ordered = filled.orderBy(*spec.keys, spec.date)
    return ordered.select(record_id, F.greatest("yhat", F.lit(0.0)).alias("units_sold"))


def unpredicted(filled: DataFrame, spec: SeriesSpec) -> DataFrame:
    return filled.where(F.col("yhat").isNull()).select(*spec.keys).distinct()


def require_complete_submission(filled: DataFrame, spec: SeriesSpec, shown: int = 10) -> None:
    missing = unpredicted(filled, spec)
    names = [tuple(r) for r in missing.orderBy(*spec.keys).limit(shown).collect()]
    if names:
        raise ValueError(f"no usable history for {missing.count()} series, such as {names}")


def template_differences(filled: DataFrame, template: DataFrame, record_id: str = "record_ID") -> DataFrame:
    """Records whose number of rows differs: (record, n_filled, n_template); repeated and missing ids show up alike."""
    def counted(df, name):
        return df.groupBy(F.col(record_id).cast("string").alias("record")).agg(F.count(F.lit(1)).alias(name))

    both = counted(filled, "n_filled").join(counted(template, "n_template").withColumnRenamed("record", "_record"),
                                            F.col("record").eqNullSafe(F.col("_record")), "full")
    zero = F.lit(0).cast("long")
    return both.select(F.coalesce("record", "_record").alias("record"), F.coalesce("n_filled", zero).alias("n_filled"),
                       F.coalesce("n_template", zero).alias("n_template")).where("n_filled <> n_template")


def require_template(filled: DataFrame, template: DataFrame, record_id: str = "record_ID", shown: int = 10) -> None:
    """Raise unless every record of the template is filled exactly as often as it stands there."""
    found = template_differences(filled, template, record_id).orderBy("record").limit(shown).collect()
    if found:
        raise ValueError("records differ from the template: " + ", ".join(f"{r.record} ({r.n_filled} for {r.n_template})" for r in found))


def _gaps(clean: DataFrame, trained: Trained, spec: SeriesSpec) -> DataFrame:
    total = clean.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n_train"))
    fitted = trained.hybrid.params.where("status = 'fitted'").select(*spec.keys, F.col("n_train").alias("n_fitted"))
    gap = F.greatest(F.col("n_train") - F.col("n_fitted"), F.lit(0).cast("bigint"))
    return total.join(fitted, list(spec.keys)).withColumn("gap", gap)


def _hybrid_past_gap(model: HybridModel, needs: DataFrame, spec: SeriesSpec) -> DataFrame:
    horizon = needs.withColumn("horizon", F.col("gap") + F.col("n_test"))
    ahead = hybrid_forecast(model, spec, horizon=horizon)
    return past_the_gap(ahead, needs, spec)
