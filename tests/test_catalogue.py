"""Every catalogue query with a SQL twin gives the same rows, columns and types."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from panelcast.plans.catalogue import ORACLE, QUERIES
from tests.compare import difference


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, sf_dir, name):
    assert difference(spark, con, name, sf_dir) is None


# The whole flows (M1, M3, M13-M15, M17, M19) take half a minute or more each; test_forecasting.py and test_network.py cover them.
WITHOUT_SQL = [
    "M2_windows_linear", "M3_recursive_linear", "M4_arima", "M6_residual", "M7_corrections", "M8_hybrid", "M10_panel_forecasts", "M11_model_info",
    "R7_save_load", "R7_hybrid",
]


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_runs_without_sql(spark, sf_dir, name):
    """Queries without a SQL twin give rows, and finite numbers wherever they give any."""
    rows = QUERIES[name](spark, sf_dir)
    doubles = [c for c, kind in rows.dtypes if kind == "double"]
    found = rows.select([F.count(F.lit(1)).alias("_n")] + [
        F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in doubles]).first()
    assert found[0] > 0 and not any(found[1:])


def test_entry_points(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(QUERIES) <= set(entry_points.queries())
