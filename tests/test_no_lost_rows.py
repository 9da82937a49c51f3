"""Rows that must not disappear: odd headers, date spellings, empty days, missing parameters, missing values."""

import datetime as dt

from pyspark.sql import functions as F

from panelcast.inventory.policy import recommendations
from panelcast.inventory.projection import project_inventory
from panelcast.operators.clean import parse_columns
from panelcast.operators.features import sliding_windows
from panelcast.sources import readers
from panelcast.spec import SeriesSpec

SPEC = SeriesSpec(date="date", demand="units_sold")


def test_files_with_other_column_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,demand\n2024-01-01,1\n2024-01-02,2\n")
    (tmp_path / "b c.csv").write_text("demand,date\n3,2024-01-03\n4,2024-01-04\n")
    (tmp_path / "d.csv").write_text("date,other\n2024-01-05,x\n")
    got = {r["date"]: r["demand"] for r in readers.read_folder(spark, str(tmp_path)).collect()}
    assert got == {"2024-01-01": "1", "2024-01-02": "2", "2024-01-03": "3", "2024-01-04": "4", "2024-01-05": None}


def test_date_spellings(spark):
    texts = ["2022-01-31", "01/31/2022", "31-01-2022", "20220131", "2022/01/31", "Jan 31, 2022", "nonsense"]
    df = spark.createDataFrame([(t, "1") for t in texts], "date string, units_sold string")
    got = parse_columns(df, SPEC).collect()
    assert [r["date"] for r in got] == [dt.date(2022, 1, 31)] * 6


def test_empty_day_sums_to_zero(spark):
    wide = spark.createDataFrame([("1", None, "x"), ("2", None, "3")], "d_1 string, d_2 string, d_4 string")
    got = {str(r["date"]): r["demand"] for r in readers.melt_wide(wide, "2024-01-01").collect()}
    assert got == {"2024-01-01": 3.0, "2024-01-02": 0.0, "2024-01-04": 3.0}


def test_series_without_parameters_stay(spark, panel):
    demand = panel({("a", "x"): [1, 2, 3, 4], ("b", "y"): [2, 2, 4, 4]})
    params = spark.createDataFrame(
        [("a", "x", 0.95, 7)], "store_id string, sku_id string, service_level double, lead_time int").withColumns(
        {c: F.lit(None).cast("double") for c in ("annual_demand", "holding_cost", "ordering_cost")})
    got = {r["store_id"]: r["safety_stock"] for r in recommendations(demand, SPEC, params).collect()}
    assert got["a"] > 0 and got["b"] is None
    bad = params.withColumn("service_level", F.lit(95.0))
    assert recommendations(demand, SPEC, bad).where("store_id = 'a'").first()["safety_stock"] is None


def test_series_without_policy_stay(spark):
    ahead = spark.createDataFrame([("a", "x", i, 1.0) for i in range(3)] + [("b", "y", 0, 1.0)], "store_id string, sku_id string, step int, yhat double")
    policy = spark.createDataFrame([("a", "x", 5.0, 2.0, 1)], "store_id string, sku_id string, current_stock double, reorder_point double, lead_time int")
    got = project_inventory(ahead, policy, SPEC).collect()
    assert len(got) == 4 and [r["inventory_level"] for r in got if r["store_id"] == "b"] == [None]


def test_windows_keep_missing_values(panel):
    rows = sliding_windows(panel({("a", "x"): [1, 2, None, 4, 5, 6, 7]}), SPEC, 3).collect()
    assert len(rows) == 4 and rows[0]["window"] == [1.0, 2.0, None]
