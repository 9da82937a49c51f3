"""Replenishment figures, projections and risk, with the scalar functions behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions import normal
from panelcast.functions import scalars as sc
from panelcast.inventory import policy, projection, report, risk
from panelcast.operators import alignment as al
from panelcast.operators.features import last_rows
from panelcast.operators.explore import demand_statistics
from panelcast.plans.catalogue.base import PANEL, daily, dirty, query, shown, sql, table
from panelcast.plans.catalogue.forecasts import FUTURE_SQL, future, split
from panelcast.operators.clean import clean_data
from panelcast.spec import InventoryParams

KEY = ["store_id", "sku_id"]
Z95 = repr(normal.z_value(0.95))
LEAD = 7

STATS = {
    "stats": """SELECT store_id, sku_id, avg(units_sold) AS mean, coalesce(stddev_samp(units_sold), 0) AS std FROM clean WHERE units_sold >= 0 GROUP BY ALL""",
}


def demand(spark: SparkSession, sf: str) -> DataFrame:
    return clean_data(dirty(spark, sf), PANEL)


def replenishment(demand_rows: DataFrame) -> DataFrame:
    """From clean demand to one replenishment row per series."""
    return policy.recommendations(demand_rows, PANEL, InventoryParams(lead_time=LEAD))


REC_COLUMNS = ["average_daily_demand", "demand_std_dev", "z_score", "safety_stock", "reorder_point", "demand_during_lead_time", "economic_order_quantity"]


def _rec_sql(std: str = "std", basis: str = "'historical demand variability'", source: str = "stats", eoq: str = "CAST(NULL AS DOUBLE)", z: str = Z95, level: str = "0.95", lead: str = str(LEAD)) -> str:
    stock = f"greatest({z} * {std} * sqrt({lead}), 0)"
    return f"""SELECT store_id, sku_id, mean AS average_daily_demand, std AS demand_std_dev, CAST({lead} AS INTEGER) AS lead_time_days,
                      CAST(round_even({level} * 100, 1) AS DOUBLE) AS service_level_pct, CAST({z} AS DOUBLE) AS z_score, {stock} AS safety_stock, mean * {lead} + {stock} AS reorder_point,
                      {basis} AS safety_stock_basis, mean * {lead} AS demand_during_lead_time, {eoq} AS economic_order_quantity FROM {source}"""


@query("I5_recommend", sql(_rec_sql(), ["clean"], doubles=REC_COLUMNS, **STATS))
def recommend(spark: SparkSession, sf: str) -> DataFrame:
    return shown(replenishment(demand(spark, sf)))


FORECAST_STATS = {
    **STATS, **FUTURE_SQL,
    "fc": "SELECT store_id, sku_id, stddev_samp(yhat) AS fstd, avg(yhat) AS fmean FROM future WHERE model = 'Ensemble' AND store_id <> 'S4' GROUP BY ALL",
    "with_fc": "SELECT * FROM stats LEFT JOIN fc USING (store_id, sku_id)",
}


@query("I5_recommend_forecast", sql(
    _rec_sql("coalesce(fstd, std)", "CASE WHEN fstd IS NOT NULL THEN 'forecast variability' ELSE 'historical demand variability' END", "with_fc",
             "sqrt(2.0 * 5000 * 50 / 2.5)"), ["clean", "daily"], doubles=REC_COLUMNS, **FORECAST_STATS))
def recommend_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Forecast basis where there is one; one store has none."""
    ahead = future(spark, sf).where("model = 'Ensemble' AND store_id <> 'S4'")
    params = InventoryParams(0.95, LEAD, annual_demand=5000, holding_cost=2.5, ordering_cost=50)
    return shown(policy.recommendations(demand(spark, sf), PANEL, params, ahead))


# ---- normal distribution as SQL text, from the same fixed values


def _horner(coefficients: list[float], x: str) -> str:
    text = repr(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + CAST({c!r} AS DOUBLE))"
    return text.replace(repr(coefficients[0]), f"CAST({coefficients[0]!r} AS DOUBLE)", 1)


def cdf_sql(x: str) -> str:
    a = f"abs({x})"
    near = f"exp(-{a} * {a} / 2) * {_horner(normal.HART_TOP, a)} / {_horner(normal.HART_BOTTOM, a)}"
    far = f"exp(-{a} * {a} / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + CAST(0.65 AS DOUBLE)))))) / sqrt(2 * pi())"
    tail = f"CASE WHEN {a} < 7.07106781186547 THEN {near} ELSE {far} END"
    return f"CASE WHEN {x} > 0 THEN 1 - ({tail}) ELSE {tail} END"


def inverse_start_sql(p: str) -> str:
    c, sq = f"({p} - CAST(0.5 AS DOUBLE))", f"(({p} - CAST(0.5 AS DOUBLE)) * ({p} - CAST(0.5 AS DOUBLE)))"
    lo, hi = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    return f"""CASE WHEN {p} < 0.02425 THEN {_horner(normal.ACKLAM_C, lo)} / {_horner(normal.ACKLAM_D, lo)}
                    WHEN {p} > 1 - 0.02425 THEN -{_horner(normal.ACKLAM_C, hi)} / {_horner(normal.ACKLAM_D, hi)}
                    ELSE {c} * {_horner(normal.ACKLAM_A, sq)} / {_horner(normal.ACKLAM_B, sq)} END"""


@query("L7_z", f"""
    WITH levels AS (SELECT p_partkey, CAST(p_size + 49 AS INTEGER) AS percent, CAST(p_size + 49 AS DOUBLE) / 100 AS p FROM part),
    start AS (SELECT *, {inverse_start_sql('p')} AS s FROM levels)
    SELECT p_partkey, percent, coalesce((MAP {{{", ".join(f"{k}: {v}" for k, v in normal.Z_TABLE.items())}}})[percent], 1.645) + CAST(0 AS DOUBLE) AS z_table,
           round(s - ({cdf_sql('s')} - p) / (exp(-s * s / 2) / sqrt(2 * pi())), 6) + 0 AS z_exact FROM start""")
def z_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Service levels of 50 to 99 percent from the part sizes."""
    percent = (F.col("p_size") + 49).cast("int")
    rows = table(spark, sf, "part").select("p_partkey", percent.alias("percent"))
    return shown(rows.withColumns(
        {"z_table": normal.z_from_table(F.col("percent")), "z_exact": normal.normal_inverse(F.col("percent").cast("double") / 100)}
    ))


@query("L8_normal_cdf", f"SELECT c_custkey, round({cdf_sql('x')}, 6) + 0 AS probability FROM (SELECT c_custkey, c_acctbal / 2000 - 2 AS x FROM customer)")
def cdf(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer")
    return shown(rows.select("c_custkey", normal.normal_cdf(F.col("c_acctbal") / 2000 - 2).alias("probability")))


@query("I1_safety", sql(f"SELECT store_id, sku_id, greatest({Z95} * std * sqrt(7), 0) AS safety_stock FROM stats", ["clean"], doubles=["safety_stock"], **STATS))
def safety(spark: SparkSession, sf: str) -> DataFrame:
    stats = demand_statistics(demand(spark, sf), PANEL)
    stock = policy.safety_stock(F.lit(normal.z_value(0.95)), F.col("std_demand"), F.lit(LEAD))
    return shown(stats.select(*KEY, stock.alias("safety_stock")))


@query("I2_safety_fc", sql(
    f"SELECT store_id, sku_id, greatest({Z95} * coalesce(stddev_samp(yhat), 0) * sqrt(7), 0) AS safety_stock FROM future WHERE model = 'Ensemble' GROUP BY ALL",
    ["daily"], doubles=["safety_stock"], **FUTURE_SQL))
def safety_forecast(spark: SparkSession, sf: str) -> DataFrame:
    ahead = future(spark, sf).where("model = 'Ensemble'")
    return shown(policy.forecast_safety_stock(ahead, PANEL, 0.95, LEAD).select(*KEY, "safety_stock"))


@query("I3_rop", sql(
    f"SELECT store_id, sku_id, mean * 7 AS lead_time_demand, mean * 7 + greatest({Z95} * std * sqrt(7), 0) AS reorder_point FROM stats",
    ["clean"], doubles=["lead_time_demand", "reorder_point"], **STATS))
def rop(spark: SparkSession, sf: str) -> DataFrame:
    stats = demand_statistics(demand(spark, sf), PANEL)
    stock = policy.safety_stock(F.lit(normal.z_value(0.95)), F.col("std_demand"), F.lit(LEAD))
    mean = F.col("mean_demand")
    return shown(stats.select(
        *KEY, policy.lead_time_demand(mean, F.lit(LEAD)).alias("lead_time_demand"), policy.reorder_point(mean, F.lit(LEAD), stock).alias("reorder_point")
    ))


@query("I4_eoq", """
    SELECT p_partkey, round(CASE WHEN units > 0 AND p_size - 5 > 0 AND p_retailprice > 0 THEN sqrt(2.0 * units * (p_size - 5) / (p_retailprice / 100)) END, 6) AS order_quantity
    FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS units FROM lineitem GROUP BY 1) ON p_partkey = l_partkey""")
def eoq(spark: SparkSession, sf: str) -> DataFrame:
    """Part size less five is the ordering cost, so that small parts have none; 1 % of the price holds a unit."""
    units = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("units"))
    rows = table(spark, sf, "part").join(units, "p_partkey", "left")
    q = policy.order_quantity(F.col("units"), F.col("p_size") - 5, F.col("p_retailprice") / 100)
    return shown(rows.select("p_partkey", q.alias("order_quantity")))


# ---- projection: the last 30 daily values of each series serve as its forecast

HORIZON = 30
STOCK = 300.0
POLICY_SQL = {
    "fc": """SELECT store_id, sku_id, row_number() OVER (PARTITION BY store_id, sku_id ORDER BY date) - 1 AS period, units_sold AS demand
             FROM (SELECT *, row_number() OVER (PARTITION BY store_id, sku_id ORDER BY date DESC) AS back FROM daily) WHERE back <= 30""",
    "pol": f"""SELECT store_id, sku_id, avg(demand) AS mean, greatest({Z95} * coalesce(stddev_samp(demand), 0) * sqrt(7), 0) AS safety_stock,
                      avg(demand) * 7 + greatest({Z95} * coalesce(stddev_samp(demand), 0) * sqrt(7), 0) AS reorder_point,
                      list(demand ORDER BY period) AS demands FROM fc GROUP BY ALL""",
}


def _projection_sql(aware: bool) -> dict[str, str]:
    qty = "greatest(mean * 30, reorder_point * 2)"
    on_hand = f"level + CASE WHEN period + 1 >= 7 AND flags[period + 1 - 7 + 1] THEN {qty} ELSE 0 END"
    open_now = f"(SELECT count(*) FILTER (WHERE f) FROM (SELECT unnest(flags[greatest(period + 1 - 7 + 2, 1):]) AS f)) * {qty}"
    check = f"stock + {open_now} <= reorder_point" if aware else "stock <= reorder_point"
    return {
        **POLICY_SQL,
        "walk": f"""
          SELECT store_id, sku_id, mean, reorder_point, demands, -1 AS period, CAST({STOCK} AS DOUBLE) AS level, CAST([] AS BOOLEAN[]) AS flags FROM pol
          UNION ALL
          SELECT store_id, sku_id, mean, reorder_point, demands, period + 1, greatest(stock - demands[period + 2], 0), list_append(flags, {check})
          FROM (SELECT *, {on_hand} AS stock FROM walk WHERE period + 1 < len(demands))""",
    }


PROJECTED = "SELECT store_id, sku_id, CAST(period AS INTEGER) AS period, demands[period + 1] AS forecast_demand, level AS inventory_level, flags[period + 1] AS order_placed FROM walk WHERE period >= 0"


def projected(spark: SparkSession, sf: str, mode: str = "on_hand") -> tuple[DataFrame, DataFrame]:
    ahead = al.numbered(last_rows(daily(spark, sf), PANEL, HORIZON), PANEL).withColumnRenamed("units_sold", "yhat")
    rules = projection.default_policy(policy.forecast_spread(ahead, PANEL), PANEL, normal.z_value(0.95), STOCK, LEAD)
    return projection.project_inventory(ahead, rules, PANEL, mode), rules


@query("I6_projection", sql(PROJECTED, ["daily"], doubles=["forecast_demand", "inventory_level"], recursive=True, **_projection_sql(False)))
def project(spark: SparkSession, sf: str) -> DataFrame:
    return shown(projected(spark, sf)[0])


@query("I6_projection_on_order", sql(PROJECTED, ["daily"], doubles=["forecast_demand", "inventory_level"], recursive=True, **_projection_sql(True)))
def project_aware(spark: SparkSession, sf: str) -> DataFrame:
    return shown(projected(spark, sf, "on_order_aware")[0])


@query("I7_projection_summary", sql(
    """SELECT store_id, sku_id, count(*) FILTER (WHERE level <= 0) AS stockout_days, count(*) FILTER (WHERE level <= safety_stock) AS below_safety_days,
              count(*) FILTER (WHERE flags[period + 1]) AS orders_placed
       FROM walk JOIN (SELECT store_id, sku_id, safety_stock FROM pol) USING (store_id, sku_id) WHERE period >= 0 GROUP BY ALL""",
    ["daily"], recursive=True, **_projection_sql(False)))
def project_summary(spark: SparkSession, sf: str) -> DataFrame:
    days, rules = projected(spark, sf)
    return projection.projection_summary(days, rules, PANEL)


@query("I8_stockout", sql(
    f"""SELECT store_id, sku_id, CASE WHEN std = 0 THEN CASE WHEN 200 >= mean * 7 THEN 0 ELSE 1 END ELSE greatest(0, least(1, 1 - ({cdf_sql('z')}))) END AS stockout_probability
        FROM (SELECT *, (200 - mean * 7) / nullif(std * sqrt(7), 0) AS z FROM stats)""", ["clean"], doubles=["stockout_probability"], **STATS))
def stockout(spark: SparkSession, sf: str) -> DataFrame:
    return shown(risk.stockout_risk(demand(spark, sf), PANEL, 200, LEAD))


@query("I9_overstock", sql(
    "SELECT store_id, sku_id, greatest(900 - mean * 30, 0) * CAST(0.5 AS DOUBLE) * 30 AS overstock_cost FROM stats", ["clean"], doubles=["overstock_cost"], **STATS))
def overstock(spark: SparkSession, sf: str) -> DataFrame:
    return shown(risk.overstock_risk(demand(spark, sf), PANEL, 900, 0.5, 30))


STOCKS = "SELECT 'S' || CAST(s AS VARCHAR) AS store_id, p_brand AS sku_id, CAST(sum(p_size) AS DOUBLE) AS current_stock, CAST(max(p_size) % 9 + 1 AS INTEGER) AS lead_time, min(p_size) / CAST(8 AS DOUBLE) AS holding_cost FROM part, range(4) r(s) GROUP BY ALL"


def stocks(spark: SparkSession, sf: str) -> DataFrame:
    """Stock, lead time and holding cost per series, from part sizes; one store has no row."""
    by_brand = table(spark, sf, "part").groupBy(F.col("p_brand").alias("sku_id")).agg(
        F.sum("p_size").cast("double").alias("current_stock"), (F.max("p_size") % 9 + 1).cast("int").alias("lead_time"),
        (F.min("p_size") / F.lit(8.0)).alias("holding_cost"),
    )
    stores = F.explode(F.array(*[F.lit(f"S{i}") for i in range(4)]))
    return by_brand.withColumn("store_id", stores)


@query("I8_stockout_table", sql(
    f"""SELECT store_id, sku_id, CASE WHEN std = 0 THEN CASE WHEN current_stock >= mean * lead_time THEN 0 WHEN current_stock < mean * lead_time THEN 1 END
               WHEN z IS NOT NULL THEN greatest(0, least(1, 1 - ({cdf_sql('z')}))) END AS stockout_probability
        FROM (SELECT *, (current_stock - mean * lead_time) / nullif(std * sqrt(lead_time), 0) AS z FROM stats LEFT JOIN stocks USING (store_id, sku_id))""",
    ["clean"], doubles=["stockout_probability"], stocks=STOCKS, **STATS))
def stockout_table(spark: SparkSession, sf: str) -> DataFrame:
    return shown(risk.stockout_risk(demand(spark, sf), PANEL, stocks(spark, sf).drop("holding_cost")))


@query("I9_overstock_table", sql(
    """SELECT store_id, sku_id, CASE WHEN current_stock IS NOT NULL THEN greatest(current_stock - mean * 30, 0) * holding_cost * 30 END AS overstock_cost
       FROM stats LEFT JOIN stocks USING (store_id, sku_id)""", ["clean"], doubles=["overstock_cost"], stocks=STOCKS, **STATS))
def overstock_table(spark: SparkSession, sf: str) -> DataFrame:
    return shown(risk.overstock_risk(demand(spark, sf), PANEL, stocks(spark, sf).drop("lead_time"), horizon=30))


@query("I10_params", """
    SELECT p_partkey, concat_ws('; ', CASE WHEN NOT (level > 0 AND level < 1) THEN 'service_level must lie strictly between 0 and 1' END,
               CASE WHEN NOT lead BETWEEN 1 AND 365 THEN 'lead_time must be 1 to 365 days' END, CASE WHEN p_size - 3 <= 0 THEN 'ordering_cost must be positive' END) AS reason
    FROM (SELECT *, p_size / CAST(40 AS DOUBLE) AS level, p_size - 2 AS lead FROM part)
    WHERE NOT (level > 0 AND level < 1) OR NOT lead BETWEEN 1 AND 365 OR p_size - 3 <= 0""")
def params(spark: SparkSession, sf: str) -> DataFrame:
    """A parameter table in which some part sizes lead out of range."""
    size = F.col("p_size")
    rows = table(spark, sf, "part").select(
        "p_partkey", (size / F.lit(40.0)).alias("service_level"), (size - 2).alias("lead_time"),
        F.lit(None).cast("double").alias("annual_demand"), F.lit(None).cast("double").alias("holding_cost"), (size - 3).cast("double").alias("ordering_cost"),
    )
    return policy.check_params(rows).select("p_partkey", "reason")


@query("I11_source", sql(
    """SELECT store_id, sku_id, CAST(pos - split_idx + 1 AS INTEGER) AS step, units_sold AS yhat, 'test predictions' AS source FROM parts WHERE pos >= split_idx AND store_id <> 'S4'
       UNION ALL SELECT store_id, sku_id, step, yhat, 'future forecast' FROM future WHERE model = 'Ensemble'
         AND (store_id, sku_id) NOT IN (SELECT (store_id, sku_id) FROM parts WHERE store_id <> 'S4')""",
    ["placed"], doubles=["yhat"], **FUTURE_SQL,
    parts="""SELECT *, least(greatest(CAST(floor(CAST(n_rows AS DOUBLE) * CAST(0.8 AS DOUBLE)) AS BIGINT), 10), n_rows - 1) AS split_idx FROM placed WHERE n_rows >= 20"""))
def source(spark: SparkSession, sf: str) -> DataFrame:
    """Test rows stand in for their predictions; one store has none and uses its future forecast."""
    _, test = split(spark, sf)
    predicted = al.numbered(test, PANEL).where("store_id <> 'S4'").withColumnRenamed("units_sold", "yhat")
    return shown(policy.choose_demand_source(predicted, future(spark, sf), PANEL))


@query("L3_nearest", "SELECT o_orderkey, round_even(o_totalprice / 5, 0) * 5 AS nearest FROM orders")
def nearest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", sc.round_to_nearest(F.col("o_totalprice"), 5).alias("nearest"))


@query("L4_format_metrics", sql(
    "SELECT store_id, sku_id, round_even(mean, 3) AS mean, round_even(std, 3) AS std FROM stats", ["clean"], **STATS))
def format_metrics(spark: SparkSession, sf: str) -> DataFrame:
    stats = demand_statistics(demand(spark, sf), PANEL)
    pairs = F.create_map(F.lit("mean"), F.col("mean_demand"), F.lit("std"), F.col("std_demand"))
    rows = stats.select(*KEY, sc.format_metrics(pairs, 3).alias("m"))
    return rows.select(*KEY, F.col("m")["mean"].alias("mean"), F.col("m")["std"].alias("std"))


@query("L5_suffix", """
    SELECT o_custkey, CASE WHEN total >= 1000000 THEN printf('%.1fM', CAST(round_even(total / 1000000, 1) AS DOUBLE)) WHEN total >= 1000 THEN printf('%.1fK', CAST(round_even(total / 1000, 1) AS DOUBLE))
                           ELSE printf('%.1f', CAST(total AS DOUBLE)) END AS short FROM (SELECT o_custkey, CAST(count(*) * count(*) * 900 AS DECIMAL(18, 4)) AS total FROM orders GROUP BY 1)""")
def suffix(spark: SparkSession, sf: str) -> DataFrame:
    counted = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("o_custkey", sc.short_number((F.col("n") * F.col("n") * 900).cast("double")).alias("short"))


@query("L6_order", """
    SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN '1,1,1' ELSE p_size || ',1,' || (p_size + 1) END AS "order" FROM part""")
def parse_order(spark: SparkSession, sf: str) -> DataFrame:
    """Text such as '3, 1, 4', and the bare type where there is no order to read."""
    text = F.when(F.col("p_type") == "ECONOMY", F.col("p_type")).otherwise(
        F.concat_ws(", ", F.col("p_size").cast("string"), F.lit("1"), (F.col("p_size") + 1).cast("string"))
    )
    return table(spark, sf, "part").select("p_partkey", F.array_join(sc.parse_order(text).cast("array<string>"), ",").alias("order"))


@query("L11_report", sql(
    """SELECT store_id, sku_id, 'Replenishment report' || chr(10) || printf('service level %.1f%%, z %.4f', service_level_pct, round_even(z_score, 4)) || chr(10)
         || printf('daily demand %.2f +/- %.2f units', round_even(average_daily_demand, 2), round_even(demand_std_dev, 2)) || chr(10)
         || printf('lead time %d days, demand in lead time %.1f units', lead_time_days, round_even(demand_during_lead_time, 1)) || chr(10)
         || printf('safety stock = z * deviation * sqrt(lead time) = %.1f units (%s)', round_even(safety_stock, 1), safety_stock_basis) || chr(10)
         || printf('reorder point = demand in lead time + safety stock = %.1f units', round_even(reorder_point, 1)) AS report FROM recs""",
    ["clean"], **STATS, recs=_rec_sql()))
def reports(spark: SparkSession, sf: str) -> DataFrame:
    rows = policy.recommendations(demand(spark, sf), PANEL, InventoryParams(lead_time=LEAD), display=True)
    return report.report_text(rows, PANEL)
