"""Safety stock, reorder point, order quantity and recommendations, for all series at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.moments import sample_std
from panelcast.functions.normal import normal_inverse, z_value
from panelcast.operators.explore import demand_statistics
from panelcast.spec import InventoryParams, SeriesSpec

FORECAST_BASIS = "forecast variability"
HISTORY_BASIS = "historical demand variability"


def safety_stock(z: Column, std: Column, lead_time: Column) -> Column:
    """NULL when an input is missing."""
    stock = z * std * F.sqrt(lead_time.cast("double"))
    return F.when(stock.isNotNull(), F.greatest(F.lit(0.0), stock))


def lead_time_demand(mean: Column, lead_time: Column) -> Column:
    return mean * lead_time


def reorder_point(mean: Column, lead_time: Column, stock: Column) -> Column:
    return lead_time_demand(mean, lead_time) + stock


def order_quantity(annual_demand: Column, ordering_cost: Column, holding_cost: Column) -> Column:
    """Economic order quantity; NULL unless all three inputs are positive."""
    positive = (annual_demand > 0) & (ordering_cost > 0) & (holding_cost > 0)
    return F.when(positive, F.sqrt(2.0 * annual_demand * ordering_cost / holding_cost))


def forecast_spread(forecasts: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Deviation and length of each forecast."""
    return forecasts.groupBy(*spec.keys).agg(
        sample_std(F.col("yhat")).alias("forecast_std"), F.count("yhat").alias("n_forecast"), F.avg("yhat").alias("forecast_mean")
    )


def forecast_safety_stock(forecasts: DataFrame, spec: SeriesSpec, service_level: float = 0.95, lead_time: int = 1) -> DataFrame:
    stock = safety_stock(F.lit(z_value(service_level)), F.col("forecast_std"), F.lit(lead_time))
    return forecast_spread(forecasts, spec).withColumn("safety_stock", stock)


def params_frame(series: DataFrame, params: InventoryParams) -> DataFrame:
    """One parameter set for every series."""
    number = lambda v: F.lit(None if v is None else float(v)).cast("double")
    return series.withColumns(
        {
            "service_level": F.lit(params.service_level), "lead_time": F.lit(params.lead_time),
            "annual_demand": number(params.annual_demand), "holding_cost": number(params.holding_cost),
            "ordering_cost": number(params.ordering_cost),
        }
    )


def check_params(params: DataFrame) -> DataFrame:
    """Rows of a parameter table that break a range, with the reason."""
    def positive(c: str) -> Column:
        return F.when(F.col(c) <= 0, F.lit(f"{c} must be positive"))

    reasons = [
        F.when(~((F.col("service_level") > 0) & (F.col("service_level") < 1)), "service_level must lie strictly between 0 and 1"),
        F.when(~F.col("lead_time").between(1, 365), "lead_time must be 1 to 365 days"),
        positive("annual_demand"), positive("holding_cost"), positive("ordering_cost"),
    ]
    return params.withColumn("reason", F.concat_ws("; ", *reasons)).where("reason <> ''")


def require_params(params: DataFrame, shown: int = 10) -> None:
    """Raise when rows of a parameter table break a range; the first few are named with the reason."""
    bad = check_params(params).limit(shown).collect()
    if bad:
        raise ValueError("invalid parameters: " + "; ".join(str(r.asDict()) for r in bad))


def recommendations(
    demand: DataFrame,
    spec: SeriesSpec,
    params: InventoryParams | DataFrame | None = None,
    forecasts: DataFrame | None = None,
    display: bool = False,
) -> DataFrame:
    """One replenishment row per series.

    ``params`` is one set for all, or a table with a row per series, whose rows outside the ranges give NULL figures; see
    ``require_params`` and ``plans.training.stock_plan`` for flows that refuse them. The forecast sets the safety
    stock wherever it has more than one value. ``display`` rounds as the report shows the figures.
    """
    keys = list(spec.keys)
    stats = demand_statistics(demand, spec)
    if isinstance(params, DataFrame):
        rows = stats.join(params, keys, "left")  # a series without parameters keeps its row, with NULL figures
        z = normal_inverse(F.col("service_level"))
    else:
        params = params or InventoryParams()
        rows = params_frame(stats, params)
        z = F.lit(z_value(params.service_level))
    history_std = F.col("std_demand")
    if forecasts is None:
        std, basis = history_std, F.lit(HISTORY_BASIS)
    else:
        rows = rows.join(forecast_spread(forecasts, spec), keys, "left")
        from_forecast = F.coalesce(F.col("n_forecast") > 1, F.lit(False))
        std = F.when(from_forecast, F.col("forecast_std")).otherwise(history_std)
        basis = F.when(from_forecast, FORECAST_BASIS).otherwise(HISTORY_BASIS)
    mean, lead = F.col("mean_demand"), F.col("lead_time")
    stock = safety_stock(z, std, lead)

    def shown(value: Column, digits: int) -> Column:
        return F.bround(value, digits) if display else value

    return rows.select(
        *keys,
        shown(mean, 2).alias("average_daily_demand"),
        shown(history_std, 2).alias("demand_std_dev"),
        lead.cast("int").alias("lead_time_days"),
        F.bround(F.col("service_level") * 100, 1).alias("service_level_pct"),
        shown(z, 4).alias("z_score"),
        shown(stock, 1).alias("safety_stock"),
        shown(reorder_point(mean, lead, stock), 1).alias("reorder_point"),
        basis.alias("safety_stock_basis"),
        shown(lead_time_demand(mean, lead), 1).alias("demand_during_lead_time"),
        shown(order_quantity(F.col("annual_demand"), F.col("ordering_cost"), F.col("holding_cost")), 1).alias("economic_order_quantity"),
    )


def choose_demand_source(test_predictions: DataFrame, future: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Test predictions where a series has them, else its ensemble future forecast."""
    on = list(spec.keys)
    has_test = test_predictions.select(*on).distinct()
    rest = future.where(F.col("model") == "Ensemble").join(has_test, on, "left_anti")
    columns = [*on, "step", "yhat"]
    return test_predictions.select(*columns, F.lit("test predictions").alias("source")).unionByName(
        rest.select(*columns, F.lit("future forecast").alias("source"))
    )
