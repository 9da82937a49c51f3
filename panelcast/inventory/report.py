"""Readable replenishment report, one text per series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.spec import SeriesSpec


def report_text(recommendations: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Text built from the columns of ``recommendations``; the order quantity line only where there is one."""
    lines = [
        F.lit("Replenishment report"),
        F.format_string("service level %.1f%%, z %.4f", "service_level_pct", "z_score"),
        F.format_string("daily demand %.2f +/- %.2f units", "average_daily_demand", "demand_std_dev"),
        F.format_string("lead time %d days, demand in lead time %.1f units", "lead_time_days", "demand_during_lead_time"),
        F.format_string("safety stock = z * deviation * sqrt(lead time) = %.1f units (%s)", "safety_stock", "safety_stock_basis"),
        F.format_string("reorder point = demand in lead time + safety stock = %.1f units", "reorder_point"),
        F.when(F.col("economic_order_quantity").isNotNull(), F.format_string("economic order quantity %.1f units", "economic_order_quantity")),
    ]
    return recommendations.select(*spec.keys, F.concat_ws("\n", *lines).alias("report"))
