"""Forecasters whose parameters are plain aggregates: carried level, AR(1), and AR(1) on differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.spec import SeriesSpec


def _over_steps(params: DataFrame, spec: SeriesSpec, model: str, steps: int | DataFrame, yhat) -> DataFrame:
    """One row per step; ``steps`` is one number, or a table (keys, horizon) with a horizon for each series."""
    if isinstance(steps, DataFrame):
        ahead = params.join(steps.select(*spec.keys, "horizon"), list(spec.keys)).where("horizon > 0")
        until = F.col("horizon").cast("int")
    else:
        ahead, until = params, F.lit(int(steps))
    rows = ahead.withColumn("step", F.explode(F.sequence(F.lit(1), until)))
    return rows.select(
        *spec.keys, F.lit(model).alias("model"), "step",
        F.date_add(F.col("last_date").cast("date"), F.col("step")).alias("date"),
        yhat(F.col("step")).alias("yhat"),
    )


def naive_forecast(df: DataFrame, spec: SeriesSpec, steps: int | DataFrame) -> DataFrame:
    """Order (0,1,0): the last value carried forward."""
    last = df.groupBy(*spec.keys).agg(
        F.max(spec.date).alias("last_date"), F.max_by(spec.demand, spec.date).alias("level")
    )
    return _over_steps(last, spec, "Naive", steps, lambda h: F.col("level"))


def fit_ar1(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Order (1,0,0) with constant: least squares of each value on its predecessor.

    A series without two different predecessors keeps slope 0 and its mean as constant.
    """
    v = F.col(spec.demand)
    lagged = df.withColumn("_prev", F.lag(v).over(spec.ordered()))
    return lagged.groupBy(*spec.keys).agg(
        F.coalesce(F.regr_slope(v, F.col("_prev")), F.lit(0.0)).alias("phi"),
        F.coalesce(F.regr_intercept(v, F.col("_prev")), F.avg(v)).alias("const"),
        F.count("_prev").alias("n_pairs"),
        F.max(spec.date).alias("last_date"), F.max_by(v, spec.date).alias("level"),
    )


def ar1_forecast(df: DataFrame, spec: SeriesSpec, steps: int | DataFrame) -> DataFrame:
    phi, const, level = F.col("phi"), F.col("const"), F.col("level")

    def yhat(h: Column) -> Column:
        drift = F.when(F.abs(1 - phi) < 1e-12, const * h).otherwise(const * (1 - F.pow(phi, h)) / (1 - phi))
        return F.pow(phi, h) * level + drift

    return _over_steps(fit_ar1(df, spec), spec, "AR1", steps, yhat)


def fit_diff_ar1(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Order (1,1,0): slope through the origin of each change on the change before."""
    v = F.col(spec.demand)
    order = spec.ordered()
    changes = df.withColumn("_d", v - F.lag(v).over(order)).withColumn("_p", F.lag("_d").over(order))
    return changes.groupBy(*spec.keys).agg(
        F.coalesce(F.sum(F.col("_d") * F.col("_p")) / F.nullif(F.sum(F.when(F.col("_d").isNotNull(), F.col("_p") * F.col("_p"))), F.lit(0.0)), F.lit(0.0)).alias("phi"),
        F.max(spec.date).alias("last_date"), F.max_by(v, spec.date).alias("level"),
        F.coalesce(F.max_by("_d", spec.date), F.lit(0.0)).alias("change"),
    )


def diff_ar1_forecast(df: DataFrame, spec: SeriesSpec, steps: int | DataFrame) -> DataFrame:
    phi = F.col("phi")

    def yhat(h: Column) -> Column:
        series = F.when(F.abs(1 - phi) < 1e-12, h.cast("double")).otherwise(phi * (1 - F.pow(phi, h)) / (1 - phi))
        return F.col("level") + F.col("change") * series

    return _over_steps(fit_diff_ar1(df, spec), spec, "DiffAR1", steps, yhat)


def ar1_residuals(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Value minus one-step fit of order (1,0,0); the first row of a series has none."""
    params = fit_ar1(df, spec).select(*spec.keys, "phi", "const")
    v = F.col(spec.demand)
    lagged = df.withColumn("_prev", F.lag(v).over(spec.ordered())).where(F.col("_prev").isNotNull())
    return lagged.join(params, list(spec.keys)).select(
        *spec.keys, spec.date, (v - F.col("const") - F.col("phi") * F.col("_prev")).alias("resid")
    )
