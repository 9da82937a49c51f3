"""What the flows leave behind: runs, their metrics, forecasts and stock analyses, as tables that later runs add to.

Every table is append-only Parquet, partitioned by ``run_id``; a run that is written again replaces its own rows. Metrics are
unique by (model, version): the pair is claimed by creating a file that must not exist, so that of two writers one succeeds.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.sinks import files
from panelcast.sinks.writers import append_run, read_runs
from panelcast.spec import SeriesSpec


class RunStore:
    """Tables ``runs``, ``metrics``, ``forecasts`` and ``analyses`` below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _write(self, table: str, df: DataFrame, run_id: str) -> None:
        append_run(df, f"{self.path}/{table}", run_id)

    def table(self, name: str) -> DataFrame:
        return read_runs(self.spark, f"{self.path}/{name}")

    def claim(self, model: str, version: str, run_id: str) -> None:
        """Take (model, version) for a run; raises when another run has it."""
        key = hashlib.sha256(f"{len(model)}:{model}{version}".encode()).hexdigest()
        path = f"{self.path}/_claims/{key}"
        if files.create_once(self.spark, path, run_id):
            return
        owner = files.first_bytes(self.spark, [path])[0]
        if owner != run_id.encode():
            raise ValueError(f"metrics of model {model!r}, version {version!r} belong to run {owner!r}")

    def record_run(self, runs: DataFrame, run_id: str, status: str = "completed") -> None:
        """Rows (model, seconds, losses, val_losses) of one training."""
        self._write("runs", runs.withColumns({"status": F.lit(status), "stored_at": F.current_timestamp()}), run_id)

    def record_metrics(self, metrics: DataFrame, run_id: str, version: str, start: Column, end: Column, horizon: Column) -> None:
        """One row per model with its test period and horizon."""
        models = [r.model for r in metrics.select("model").distinct().collect()]  # a handful: sequence, hybrid, ensemble
        for model in sorted(models):
            self.claim(model, version, run_id)
        self._write("metrics", metrics.withColumns({
            "version": F.lit(version), "test_start": start, "test_end": end, "horizon": horizon,
            "evaluated_at": F.current_timestamp()}), run_id)

    def record_forecasts(self, forecasts: DataFrame, run_id: str, spec: SeriesSpec, origin: Column) -> None:
        """Rows (keys, model, step, date, yhat); ``origin`` is the last date that the forecast knew."""
        self._write("forecasts", forecasts.select(*spec.keys, "model", origin.alias("origin"), "step", "date", "yhat"), run_id)

    def record_analysis(self, plan: DataFrame, run_id: str) -> None:
        """Replenishment rows of one run, with whatever columns they have."""
        self._write("analyses", plan, run_id)

    def record_training(self, trained, spec: SeriesSpec, run_id: str, version: str) -> None:
        """Runs and metrics of ``train_and_backtest``."""
        self.record_run(trained.runs, run_id)
        span = trained.backtest.agg(
            F.min(spec.date).cast("date").alias("a"), F.max(spec.date).cast("date").alias("b")).first()
        steps = trained.backtest.groupBy("model", *spec.keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()
        self.record_metrics(trained.metrics, run_id, version, F.lit(span.a), F.lit(span.b), F.lit(steps.n))

    def analytics(self) -> DataFrame:
        """Models trained and judged over all runs, training time, and the best model of the newest metrics."""
        newest = self.table("metrics").groupBy("model").agg(F.max_by("rmse", F.struct("evaluated_at", "version")).alias("rmse"))
        runs = self.table("runs")
        best = newest.agg(F.min_by("model", F.struct("rmse", "model")).alias("m"), F.count(F.lit(1)).alias("n"))
        return runs.agg(F.count_distinct("model").alias("models_trained"), F.sum("seconds").alias("total_training_time")).select(
            best.select("n").scalar().alias("models_evaluated"), "models_trained", "total_training_time",
            best.select("m").scalar().alias("best_model"))
