"""Exploratory statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.scalars import MONTHS, WEEKDAYS
from panelcast.operators import explore as e
from panelcast.operators.calendar import time_features
from panelcast.operators.features import lag_features
from panelcast.plans.catalogue.base import PANEL, SINGLE, daily, dirty, panel, query, shown, sql, totals
from panelcast.operators.clean import collapse_duplicates, parse_columns

KEY = ["store_id", "sku_id"]
STATS = """count(units_sold) AS count, avg(units_sold) AS mean, stddev_samp(units_sold) AS std_dev, min(units_sold) AS min, max(units_sold) AS max,
           skewness(units_sold) AS skewness, kurtosis(units_sold) AS kurtosis, quantile_cont(units_sold, 0.25) AS q1,
           quantile_cont(units_sold, 0.5) AS median, quantile_cont(units_sold, 0.75) AS q3"""
STAT_NAMES = ["mean", "std_dev", "skewness", "kurtosis", "q1", "median", "q3"]


@query("A2_summary", sql(f"SELECT {STATS} FROM daily", ["daily"], doubles=STAT_NAMES))
def summary(spark: SparkSession, sf: str) -> DataFrame:
    return shown(e.summary_statistics(daily(spark, sf), SINGLE))


@query("A2_summary_series", sql(f"SELECT store_id, sku_id, {STATS} FROM daily GROUP BY ALL", ["daily"], doubles=STAT_NAMES))
def summary_series(spark: SparkSession, sf: str) -> DataFrame:
    return shown(e.summary_statistics(daily(spark, sf), PANEL))


DEMAND = """avg(units_sold) AS mean_demand, coalesce(stddev_samp(units_sold), 0) AS std_demand, min(units_sold) AS min_demand, max(units_sold) AS max_demand,
            CASE WHEN avg(units_sold) > 0 THEN coalesce(stddev_samp(units_sold), 0) / avg(units_sold) ELSE 0 END AS cv, count(units_sold) AS n_periods"""


@query("A3_demand_stats", sql(
    f"SELECT store_id, sku_id, {DEMAND} FROM collapsed WHERE units_sold >= 0 GROUP BY ALL", ["collapsed"], doubles=["mean_demand", "std_demand", "cv"]))
def demand_stats(spark: SparkSession, sf: str) -> DataFrame:
    return shown(e.demand_statistics(collapse_duplicates(parse_columns(dirty(spark, sf), PANEL), PANEL), PANEL))


@query("A4_groups", sql("SELECT count(*) AS n_groups, min(n) AS smallest_group FROM (SELECT count(*) AS n FROM panel GROUP BY store_id, sku_id)", ["panel"]))
def groups(spark: SparkSession, sf: str) -> DataFrame:
    return e.group_sizes(panel(spark, sf), PANEL)


@query("A5_distinct", sql("SELECT count(DISTINCT store_id) AS n_store_id, count(DISTINCT sku_id) AS n_sku_id FROM panel", ["panel"]))
def distinct(spark: SparkSession, sf: str) -> DataFrame:
    return e.distinct_keys(panel(spark, sf), PANEL)


@query("A6_kpi", sql(
    """SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, avg(units_sold) AS mean_demand, stddev_samp(units_sold) AS std_demand,
              sum(units_sold) AS total_demand FROM panel""", ["panel"], doubles=["mean_demand", "std_demand", "total_demand"], dates=["first_date", "last_date"]))
def kpi(spark: SparkSession, sf: str) -> DataFrame:
    return shown(e.kpi_row(panel(spark, sf), PANEL))


def _names(values: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


def _season_sql(index: str, label: str) -> str:
    return sql(f"SELECT period, {label} AS label, average_demand FROM (SELECT CAST({index} AS INTEGER) AS period, avg(units_sold) AS average_demand FROM daily GROUP BY 1)",
               ["daily"], doubles=["average_demand"])


@query("A8_season_month", _season_sql("month(date)", f"({_names(MONTHS)})[period]"))
def season_month(spark: SparkSession, sf: str) -> DataFrame:
    return shown(e.seasonal_mean(daily(spark, sf), PANEL, "Month"))


@query("A8_season_dow", _season_sql("isodow(date) - 1", f"({_names(WEEKDAYS)})[period + 1]"))
def season_dow(spark: SparkSession, sf: str) -> DataFrame:
    return shown(e.seasonal_mean(daily(spark, sf), PANEL, "Day"))


@query("A8_season_week", _season_sql("weekofyear(date)", "CAST(period AS VARCHAR)"))
def season_week(spark: SparkSession, sf: str) -> DataFrame:
    return shown(e.seasonal_mean(daily(spark, sf), PANEL, "Week"))


@query("A9_box", sql(
    f"""SELECT *, ({_names(MONTHS)})[month] AS label FROM (SELECT CAST(month(date) AS INTEGER) AS month, count(units_sold) AS n, min(units_sold) AS min, max(units_sold) AS max,
        quantile_cont(units_sold, 0.25) AS q1, quantile_cont(units_sold, 0.5) AS median, quantile_cont(units_sold, 0.75) AS q3 FROM daily GROUP BY 1)""",
    ["daily"], doubles=["q1", "median", "q3"]))
def box(spark: SparkSession, sf: str) -> DataFrame:
    return shown(e.monthly_box(daily(spark, sf), PANEL))


@query("A10_hist", sql(
    """SELECT bin, lo + bin * width AS bin_start, lo + (bin + 1) * width AS bin_end, n, mean AS mean_marker
       FROM (SELECT CAST(least(floor((units_sold - lo) / width), 39) AS INTEGER) AS bin, count(*) AS n, any_value(lo) AS lo, any_value(width) AS width, any_value(mean) AS mean
             FROM daily, ends GROUP BY 1)""", ["daily"], doubles=["bin_start", "bin_end", "mean_marker"],
    ends="SELECT min(units_sold) AS lo, (max(units_sold) - min(units_sold)) / CAST(40 AS DOUBLE) AS width, avg(units_sold) AS mean FROM daily"))
def hist(spark: SparkSession, sf: str) -> DataFrame:
    return shown(e.histogram(daily(spark, sf), PANEL, 40))


CORR = ["units_sold", "Month", "DayOfWeek", "Quarter", "Sales_Lag_7", "Sales_Lag_30"]


@query("A11_corr", sql(
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr(CAST(\"{a}\" AS DOUBLE), CAST(\"{b}\" AS DOUBLE)) AS corr FROM feats" for a in CORR for b in CORR
    ), ["daily"], doubles=["corr"],
    feats="""SELECT * FROM (SELECT units_sold, month(date) AS "Month", isodow(date) - 1 AS "DayOfWeek", quarter(date) AS "Quarter",
                    lag(units_sold, 7) OVER (PARTITION BY store_id, sku_id ORDER BY date) AS "Sales_Lag_7",
                    lag(units_sold, 30) OVER (PARTITION BY store_id, sku_id ORDER BY date) AS "Sales_Lag_30" FROM daily) WHERE "Sales_Lag_30" IS NOT NULL"""))
def corr(spark: SparkSession, sf: str) -> DataFrame:
    rows = time_features(lag_features(daily(spark, sf), PANEL, (7, 30)), "date")
    return shown(e.correlation_matrix(rows, CORR))


ACF_STEPS = {
    "centred": """SELECT store_id, sku_id, row_number() OVER (PARTITION BY store_id, sku_id ORDER BY date) AS t,
                         units_sold - avg(units_sold) OVER (PARTITION BY store_id, sku_id) AS x, count(*) OVER (PARTITION BY store_id, sku_id) AS n FROM daily""",
    "lags": """SELECT a.store_id, a.sku_id, k.k AS lag, sum(a.x * b.x) AS c FROM centred a, (SELECT unnest(range(0, 41)) AS k) k, centred b
               WHERE a.store_id = b.store_id AND a.sku_id = b.sku_id AND b.t = a.t - k.k AND k.k <= least(40, a.n // 2 - 1) GROUP BY ALL""",
    "acf": """SELECT store_id, sku_id, lag, c / first_value(c) OVER (PARTITION BY store_id, sku_id ORDER BY lag) AS value FROM lags""",
}


@query("A12_acf", sql("SELECT store_id, sku_id, CAST(lag AS INTEGER) AS lag, value FROM acf", ["daily"], doubles=["value"], **ACF_STEPS))
def acf(spark: SparkSession, sf: str) -> DataFrame:
    return shown(e.lag_table(e.autocorrelation(daily(spark, sf), PANEL), PANEL, "acf"))


@query("A12_pacf", sql(
    "SELECT store_id, sku_id, CAST(k AS INTEGER) AS lag, CASE WHEN k = 0 THEN 1 ELSE p END AS value FROM levinson", ["daily"], doubles=["value"], recursive=True,
    **ACF_STEPS,
    arrays="SELECT store_id, sku_id, list(value ORDER BY lag) AS r FROM acf GROUP BY ALL",
    levinson="""
      SELECT store_id, sku_id, r, 0 AS k, CAST([] AS DOUBLE[]) AS phi, CAST(1 AS DOUBLE) AS p FROM arrays
      UNION ALL
      SELECT store_id, sku_id, r, k + 1, list_append(list_transform(phi, lambda v, i: v - q * phi[len(phi) + 1 - i]), q), q
      FROM (SELECT *, (r[k + 2] - coalesce(list_sum(list_transform(phi, lambda v, i: v * r[k + 2 - i])), 0))
                      / (1 - coalesce(list_sum(list_transform(phi, lambda v, i: v * r[i + 1])), 0)) AS q FROM levinson WHERE k + 2 <= len(r))"""))
def pacf(spark: SparkSession, sf: str) -> DataFrame:
    return shown(e.lag_table(e.partial_autocorrelation(daily(spark, sf), PANEL), PANEL, "pacf"))


@query("A13_iqr", sql(
    """SELECT store_id, sku_id, date, units_sold, units_sold < q1 - 1.5 * (q3 - q1) OR units_sold > q3 + 1.5 * (q3 - q1) AS "Outlier" FROM daily, q""",
    ["daily"], dates=["date"], q="SELECT quantile_cont(units_sold, 0.25) AS q1, quantile_cont(units_sold, 0.75) AS q3 FROM daily"))
def iqr(spark: SparkSession, sf: str) -> DataFrame:
    return shown(e.flag_outliers(daily(spark, sf), PANEL))


@query("A13_iqr_series", sql(
    """SELECT store_id, sku_id, date, units_sold, units_sold < q1 - 1.5 * (q3 - q1) OR units_sold > q3 + 1.5 * (q3 - q1) AS "Outlier" FROM daily JOIN q USING (store_id, sku_id)""",
    ["daily"], dates=["date"], q="SELECT store_id, sku_id, quantile_cont(units_sold, 0.25) AS q1, quantile_cont(units_sold, 0.75) AS q3 FROM daily GROUP BY ALL"))
def iqr_series(spark: SparkSession, sf: str) -> DataFrame:
    return shown(e.flag_outliers_by_series(daily(spark, sf), PANEL))


@query("A13_z", sql(
    """SELECT store_id, sku_id, date, units_sold, abs((coalesce(units_sold, 0) - m) / s) > 2.5 AS "Outlier" FROM collapsed,
       (SELECT avg(coalesce(units_sold, 0)) AS m, stddev_pop(coalesce(units_sold, 0)) AS s FROM collapsed)""", ["collapsed"], dates=["date"]))
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    rows = collapse_duplicates(parse_columns(dirty(spark, sf), PANEL), PANEL)
    return shown(e.flag_outliers(rows, PANEL, "zscore", 2.5))


@query("A21_growth", sql(
    """SELECT store_id, sku_id, arg_min(units_sold, date) AS first_value, arg_max(units_sold, date) AS last_value,
              CASE WHEN count(*) < 2 THEN 0 ELSE (arg_max(units_sold, date) - arg_min(units_sold, date)) / nullif(arg_min(units_sold, date), 0) * 100 END AS growth_pct
       FROM daily GROUP BY ALL""", ["daily"], doubles=["growth_pct"]))
def growth(spark: SparkSession, sf: str) -> DataFrame:
    return shown(e.growth_rate(daily(spark, sf), PANEL))


def _top_sql(key: str) -> str:
    return sql(f"SELECT {key}, total, total / sum(total) OVER () * 100 AS pct FROM (SELECT {key}, sum(units_sold) AS total FROM panel GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)",
               ["panel"], doubles=["pct"])


@query("T2_top_products", _top_sql("sku_id"))
def top_products(spark: SparkSession, sf: str) -> DataFrame:
    return shown(e.top_groups(panel(spark, sf), "sku_id", "units_sold"))


@query("T2_top_stores", _top_sql("store_id"))
def top_stores(spark: SparkSession, sf: str) -> DataFrame:
    return shown(e.top_groups(panel(spark, sf), "store_id", "units_sold"))


@query("T3_top_periods", sql(
    "SELECT date, units_sold, units_sold / (SELECT sum(units_sold) FROM totals) * 100 AS pct FROM totals ORDER BY units_sold DESC, date LIMIT 5",
    ["totals"], doubles=["pct"], dates=["date"]))
def top_periods(spark: SparkSession, sf: str) -> DataFrame:
    return shown(e.top_periods(totals(spark, sf), SINGLE))


@query("W4_share", sql(
    "SELECT store_id, sku_id, total, total / sum(total) OVER () * 100 AS pct FROM (SELECT store_id, sku_id, sum(units_sold) AS total FROM panel GROUP BY ALL)",
    ["panel"], doubles=["pct"]))
def share(spark: SparkSession, sf: str) -> DataFrame:
    sums = panel(spark, sf).groupBy(*KEY).agg(F.sum("units_sold").alias("total"))
    return shown(e.share_of_total(sums, "total"))
