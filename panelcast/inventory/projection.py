"""Day-by-day stock projection as a fold over the forecast of each series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.inventory.policy import safety_stock
from panelcast.spec import SeriesSpec

# Fixed value: an order covers this many average days, or twice the reorder point if that is more.
DAYS_PER_ORDER = 30


def project_inventory(
    forecasts: DataFrame, policy: DataFrame, spec: SeriesSpec, mode: str = "on_hand", display: bool = False
) -> DataFrame:
    """Level and orders per series and period.

    ``policy`` has current_stock, reorder_point and lead_time per series. Each day receives what is
    due, orders when the stock is at or below the reorder point, then consumes demand down to zero
    at most. ``on_hand`` looks at the shelf only; ``on_order_aware`` counts open orders as well.
    Only the forecast horizon of a series is gathered, never its history.
    """
    if mode not in ("on_hand", "on_order_aware"):
        raise ValueError(f"unknown mode {mode!r}")
    gathered = forecasts.groupBy(*spec.keys).agg(
        F.sort_array(F.collect_list(F.struct("step", "yhat"))).alias("_pairs"), F.avg("yhat").alias("_mean")
    )
    rows = gathered.join(policy.select(*spec.keys, "current_stock", "reorder_point", "lead_time"), list(spec.keys), "left").withColumns(
        {
            "_demand": F.transform("_pairs", lambda p: p["yhat"]),
            "_qty": F.greatest(F.col("_mean") * DAYS_PER_ORDER, F.col("reorder_point") * 2),
            "_open_counts": F.lit(1.0 if mode == "on_order_aware" else 0.0),
        }
    )
    fold = """
      aggregate(sequence(0, size(_demand) - 1),
        named_struct('level', cast(current_stock as double), 'open', 0D,
                     'flags', cast(array() as array<boolean>), 'levels', cast(array() as array<double>)),
        (s, i) -> transform(transform(transform(
            array(if(coalesce(get(s.flags, cast(i - lead_time as int)), false), _qty, 0D)),
            arrived -> named_struct('stock', s.level + arrived, 'open', s.open - arrived)),
            r -> named_struct('stock', r.stock, 'open', r.open, 'order', r.stock + _open_counts * r.open <= reorder_point)),
            r -> named_struct(
              'level', greatest(0D, r.stock - _demand[i]),
              'open', r.open + if(r.order, _qty, 0D),
              'flags', concat(s.flags, array(r.order)),
              'levels', concat(s.levels, array(greatest(0D, r.stock - _demand[i])))))[0],
        s -> zip_with(_demand, arrays_zip(s.levels, s.flags),
                      (d, z) -> named_struct('demand', d, 'level', z.levels, 'placed', z.flags)))
    """

    def shown(c: str):
        return F.bround(c, 1) if display else F.col(c)

    # A series without a policy keeps its periods; level and orders are unknown.
    known = F.col("current_stock").isNotNull() & F.col("reorder_point").isNotNull() & F.col("lead_time").isNotNull()
    rows = rows.withColumn("_days", F.expr(fold)).withColumn("_known", known)
    return rows.select(*spec.keys, "_known", F.posexplode("_days").alias("period", "_day")).select(
        *spec.keys, "period",
        shown("_day.demand").alias("forecast_demand"), F.when(F.col("_known"), shown("_day.level")).alias("inventory_level"),
        F.when(F.col("_known"), F.col("_day.placed")).alias("order_placed"),
    )


def default_policy(spread: DataFrame, spec: SeriesSpec, z: float, current_stock: float, lead_time: int) -> DataFrame:
    """Policy from the forecast itself where none is given; ``spread`` comes from ``forecast_spread``."""
    lead = F.lit(lead_time)
    stock = safety_stock(F.lit(z), F.col("forecast_std"), lead)
    return spread.select(
        *spec.keys, F.lit(float(current_stock)).alias("current_stock"), stock.alias("safety_stock"),
        (F.col("forecast_mean") * lead + stock).alias("reorder_point"), lead.alias("lead_time"),
    )


def projection_summary(projection: DataFrame, policy: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Stock-out days, days at or below safety stock, and orders per series."""
    joined = projection.join(policy.select(*spec.keys, "safety_stock"), list(spec.keys))
    return joined.groupBy(*spec.keys).agg(
        F.count_if(F.col("inventory_level") <= 0).alias("stockout_days"),
        F.count_if(F.col("inventory_level") <= F.col("safety_stock")).alias("below_safety_days"),
        F.count_if("order_placed").alias("orders_placed"),
    )
