from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.functions import normal
from panelcast.functions import scalars as sc
from panelcast.inventory import policy, projection, report, risk
from panelcast.operators.explore import demand_statistics
from panelcast.spec import InventoryParams, SeriesSpec

SPEC = SeriesSpec()


def test_demand_statistics(panel):
    row = demand_statistics(panel({("A", "x"): [*range(10, 101, 10), -5]}), SPEC).first()
    assert row.mean_demand == 55 and round(row.std_demand, 4) == 30.2765 and row.n_periods == 10
    assert row.cv == pytest.approx(30.2765 / 55, rel=1e-4)


def test_normal_functions(spark):
    xs = [-38.0, -8.0, -3.1, -1.0, 0.0, 0.4, 2.2, 6.9, 7.5, 38.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal.normal_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r.p - NormalDist().cdf(r.x)) < 1e-14 for r in got)
    ps = [1e-9, 0.001, 0.02, 0.3, 0.5, 0.9, 0.95, 0.99, 0.99999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal.normal_inverse(F.col("p")).alias("z")).collect()
    assert all(abs(r.z - NormalDist().inv_cdf(r.p)) < 1e-9 for r in got)
    out = spark.range(1).select(normal.normal_inverse(F.lit(1.0)).alias("a"), normal.z_from_table(F.lit(87)).alias("b"), normal.z_from_table(F.lit(99)).alias("c")).first()
    assert (out.a, out.b, out.c) == (None, 1.645, 2.326)


def walk(demand, stock, rop, lead):
    """Plain restatement of the projection rule."""
    demand = np.asarray(demand, float)
    quantity = max(demand.mean() * 30, rop * 2)
    due, level, out = {}, float(stock), []
    for day, used in enumerate(demand):
        level += due.get(day, 0.0)
        order = level <= rop
        if order:
            due[day + lead] = due.get(day + lead, 0.0) + quantity
        level = max(0.0, level - used)
        out.append((level, order))
    return out


@pytest.mark.parametrize("lead", [0, 1, 7, 40])
def test_projection_matches_plain_rule(spark, lead):
    rng = np.random.default_rng(lead)
    demand = rng.uniform(80, 200, 30)
    ahead = spark.createDataFrame([("A", "x", i + 1, float(v)) for i, v in enumerate(demand)], "store_id string, sku_id string, step int, yhat double")
    rules = spark.createDataFrame([("A", "x", 1000.0, 1064.8, 70.2, lead)], "store_id string, sku_id string, current_stock double, reorder_point double, safety_stock double, lead_time int")
    days = projection.project_inventory(ahead, rules, SPEC)
    got = [(r.inventory_level, r.order_placed) for r in days.orderBy("period").collect()]
    want = walk(demand, 1000, 1064.8, lead)
    assert np.allclose([g[0] for g in got], [w[0] for w in want]) and [g[1] for g in got] == [w[1] for w in want]
    summary = projection.projection_summary(days, rules, SPEC).first()
    assert summary.orders_placed == sum(w[1] for w in want) and summary.stockout_days == sum(w[0] <= 0 for w in want)
    aware = projection.project_inventory(ahead, rules, SPEC, "on_order_aware")
    assert aware.where("order_placed").count() <= summary.orders_placed


def test_recommendations(panel, spark):
    demand = panel({("A", "x"): range(10, 101, 10)})
    row = policy.recommendations(demand, SPEC, InventoryParams(annual_demand=1000, holding_cost=2, ordering_cost=50), display=True).first()
    assert row.safety_stock == round(1.6448536 * 30.2765 * 7 ** 0.5, 1) and row.reorder_point == round(55 * 7 + 1.6448536 * 30.2765 * 7 ** 0.5, 1)
    assert row.economic_order_quantity == 223.6 and row.safety_stock_basis == policy.HISTORY_BASIS
    table = spark.createDataFrame([("A", "x", 0.99, 4, None, None, None)], "store_id string, sku_id string, service_level double, lead_time int, annual_demand double, holding_cost double, ordering_cost double")
    per_row = policy.recommendations(demand, SPEC, table).first()
    assert per_row.z_score == pytest.approx(2.3263479, abs=1e-6) and per_row.lead_time_days == 4 and per_row.economic_order_quantity is None
    text = report.report_text(policy.recommendations(demand, SPEC, display=True), SPEC).first().report
    assert "reorder point" in text and "order quantity" not in text


def test_params_are_checked():
    for bad in ({"service_level": 1.0}, {"lead_time": 0}, {"lead_time": 366}, {"holding_cost": 0}):
        with pytest.raises(ValueError):
            InventoryParams(**bad)


def test_risk(panel):
    flat = panel({("A", "x"): [10] * 5})
    assert risk.stockout_risk(flat, SPEC, 70, 7).first().stockout_probability == 0
    assert risk.stockout_risk(flat, SPEC, 69, 7).first().stockout_probability == 1
    assert risk.overstock_risk(flat, SPEC, 400, 0.5, 30).first().overstock_cost == 100 * 0.5 * 30
    assert risk.overstock_risk(flat, SPEC, 300, 0.5, 30).first().overstock_cost == 0


def test_small_functions(spark):
    row = spark.range(1).select(
        sc.short_number(F.lit(1234.0)).alias("k"), sc.short_number(F.lit(2_500_000.0)).alias("m"), sc.short_number(F.lit(None).cast("double")).alias("n"),
        sc.round_to_nearest(F.lit(12.5)).alias("r"), sc.parse_order(F.lit("2, 1 ,0")).alias("o"), sc.parse_order(F.lit("x,1,1")).alias("d"),
    ).first()
    assert tuple(row) == ("1.2K", "2.5M", "N/A", 10.0, [2, 1, 0], [1, 1, 1])
