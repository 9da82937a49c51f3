"""Stock-out probability and overstock cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.normal import normal_cdf
from panelcast.operators.explore import demand_statistics
from panelcast.spec import SeriesSpec


def stockout_probability(mean: Column, std: Column, stock: Column, lead_time: Column) -> Column:
    """Chance that demand over the lead time exceeds the stock; 0 or 1 without spread; NULL when an input is missing."""
    expected = mean * lead_time
    spread = std * F.sqrt(lead_time.cast("double"))
    certain = F.when(stock >= expected, 0.0).when(stock < expected, 1.0)
    chance = 1.0 - normal_cdf((stock - expected) / F.nullif(spread, F.lit(0.0)))
    return F.when(spread == 0, certain).when(chance.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), chance)))


def _with_inputs(rows: DataFrame, spec: SeriesSpec, inputs: DataFrame | dict[str, float]) -> DataFrame:
    """One value of each input for all series, or a table with a row per series; a series without a row gets NULL."""
    if isinstance(inputs, dict):
        return rows.withColumns({name: F.lit(value) for name, value in inputs.items()})
    return rows.join(inputs, list(spec.keys), "left")


def stockout_risk(
    demand: DataFrame, spec: SeriesSpec, current_stock: float | DataFrame, lead_time: int | None = None
) -> DataFrame:
    """``current_stock`` is one number, or a table of keys, ``current_stock`` and ``lead_time``."""
    inputs = current_stock if isinstance(current_stock, DataFrame) else {"current_stock": float(current_stock), "lead_time": lead_time}
    chance = stockout_probability(F.col("mean_demand"), F.col("std_demand"), F.col("current_stock"), F.col("lead_time"))
    return _with_inputs(demand_statistics(demand, spec), spec, inputs).select(*spec.keys, chance.alias("stockout_probability"))


def overstock_cost(mean: Column, stock: Column, holding_cost: Column, horizon: Column) -> Column:
    """NULL when an input is missing."""
    excess = stock - mean * horizon
    return F.when(excess.isNotNull(), F.greatest(excess, F.lit(0.0)) * holding_cost * horizon)


def overstock_risk(
    demand: DataFrame, spec: SeriesSpec, current_stock: float | DataFrame, holding_cost: float | None = None, horizon: int = 30
) -> DataFrame:
    """``current_stock`` is one number, or a table of keys, ``current_stock`` and ``holding_cost``."""
    inputs = current_stock if isinstance(current_stock, DataFrame) else {"current_stock": float(current_stock), "holding_cost": float(holding_cost)}
    cost = overstock_cost(F.col("mean_demand"), F.col("current_stock"), F.col("holding_cost"), F.lit(horizon))
    return _with_inputs(demand_statistics(demand, spec), spec, inputs).select(*spec.keys, cost.alias("overstock_cost"))
