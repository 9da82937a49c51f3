"""Partial sums, claims, the run store, rolling accuracy and the stored hybrid."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from panelcast.forecast.estimator import HybridForecast, HybridForecaster
from panelcast.operators.evaluate import rolling_accuracy
from panelcast.operators.registry import Registry
from panelcast.plans.store import RunStore
from panelcast.plans.training import future_forecast, require_template, stock_plan, train_and_backtest
from panelcast.sinks import files
from panelcast.spec import SeriesSpec
from panelcast.streaming.increments import PartialSums, ingest_available
from tests.test_forecasting import random_panel

SPEC = SeriesSpec()


def sums(df):
    return {(r.store_id, r.date.isoformat()): (r.units_sold, r.n_rows) for r in df.collect()}


def test_partial_sums_are_merged_not_summed_anew(spark, panel, tmp_path):
    source, target, log = (str(tmp_path / n) for n in ("in", "sums", "log"))
    schema = "store_id string, sku_id string, date string, units_sold string"

    def arrive(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}/{name}")

    columns = [F.col(c) for c in SPEC.columns]
    stream = dict(schema=spark.createDataFrame([], schema).schema, columns=columns, spec=SPEC, target=target, checkpoint=log)
    arrive([("A", "x", "2024-01-01", "1"), ("A", "x", "2024-01-01", "2"), ("A", "x", "bad", "5"), ("B", "x", "2024-01-02", "-4")], "a")
    found = ingest_available(spark, f"{source}/*", **stream)
    assert sums(found.totals()) == {("A", "2024-01-01"): (3.0, 2)}
    arrive([("A", "x", "2024-01-01", "10"), ("B", "x", "2024-01-03", "7")], "b")
    found = ingest_available(spark, f"{source}/*", **stream)
    want = {("A", "2024-01-01"): (13.0, 3), ("B", "2024-01-03"): (7.0, 1)}
    assert sums(found.totals()) == want and len(found.parts()) == 2
    # Replaying a batch replaces its own sums.
    again = spark.createDataFrame([("A", "x", "2024-01-01", "10"), ("B", "x", "2024-01-03", "7")], schema)
    assert found.add(again, 1) and sums(found.totals()) == want
    found.compact()
    assert [p.rsplit("/", 1)[1] for p in found.parts()] == ["base=1"] and sums(found.totals()) == want
    assert not found.add(again, 1) and sums(found.totals()) == want  # held by the base
    # After the base, a run reads the base and the new batch only.
    arrive([("B", "x", "2024-01-03", "1")], "c")
    found = ingest_available(spark, f"{source}/*", **stream)
    want["B", "2024-01-03"] = (8.0, 2)
    assert [p.rsplit("/", 1)[1] for p in found.parts()] == ["base=1", "batch=2"] and sums(found.totals()) == want
    # A base that was not finished counts for nothing; the next compaction overwrites it.
    spark.createDataFrame([("Z", "x", "2024-01-01", "1")], schema).write.parquet(f"{target}/base=2")
    files.remove(spark, f"{target}/base=2/_SUCCESS")
    assert sums(found.totals()) == want
    found.compact()
    assert sums(found.totals()) == want and files.names(spark, target) == ["base=1", "base=2", "batch=2"]
    with pytest.raises(ValueError, match="no batch"):
        PartialSums(spark, str(tmp_path / "none"), SPEC).totals()


def test_one_of_two_writers_registers(spark, tmp_path):
    def register(i):
        try:
            Registry(spark, str(tmp_path / "registry")).register("m", f"type{i}")
            return True
        except ValueError:
            return False

    with ThreadPoolExecutor(4) as pool:
        assert sum(pool.map(register, range(4))) == 1
    store = Registry(spark, str(tmp_path / "registry"))
    assert store.count() == 1
    store.remove("m")
    store.register("m", "again")
    assert store.get("m").first().model_type == "again"
    # A claim whose writer died before its event: taken as held at first, void later.
    lost = Registry(spark, str(tmp_path / "other"))
    lost._claim("n", False)
    with pytest.raises(ValueError, match="another writer"):
        lost.register("n", "t")
    lost.PATIENCE_SECONDS = -1.0
    lost.register("n", "t")
    assert lost.exists("n")


def test_flows_record_runs(spark, panel, tmp_path):
    df = random_panel(panel, days=90)
    store = RunStore(spark, str(tmp_path / "store"))
    trained = train_and_backtest(df, SPEC, 10, kind="linear", booster={"rounds": 2}, store=store, run_id="r1", version="1.0")
    ahead = future_forecast(trained, df, SPEC, 3, store, "r1")
    assert ahead.count() == 4 * 3 * 3
    assert {r.model for r in store.table("metrics").collect()} == {"Sequence", "Hybrid", "Ensemble"}
    row = store.table("metrics").where("model = 'Hybrid'").first()
    assert (row.version, row.run_id, row.test_end) == ("1.0", "r1", dt.date(2024, 3, 30))
    assert store.table("forecasts").agg(F.min("origin"), F.max("origin")).first() == (dt.date(2024, 3, 30),) * 2
    store.record_training(trained, SPEC, "r1", "1.0")  # the same run again
    assert store.table("runs").count() == 2 and store.table("metrics").count() == 3
    with pytest.raises(ValueError, match="belong to run"):
        store.record_training(trained, SPEC, "r2", "1.0")
    store.record_training(trained, SPEC, "r2", "1.1")
    plan = stock_plan(df, SPEC, store=store, run_id="r1")
    assert plan.count() == 4 and store.table("analyses").where("safety_stock > 0").count() == 4
    odd = df.select("store_id", "sku_id").distinct().selectExpr(
        "*", "2D AS service_level", "7 AS lead_time", "1D AS annual_demand", "1D AS holding_cost", "1D AS ordering_cost")
    with pytest.raises(ValueError, match="strictly between"):
        stock_plan(df, SPEC, odd)
    found = store.analytics().first()
    assert (found.models_evaluated, found.models_trained) == (3, 2) and found.best_model in ("Sequence", "Hybrid", "Ensemble")


def test_rolling_accuracy(spark):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    actual = spark.createDataFrame([("A", "x", day(i), v) for i, v in enumerate([10.0, 0.0, 20.0, None, 30.0])], "store_id string, sku_id string, date date, units_sold double")
    log = spark.createDataFrame(
        [("A", "x", "m", day(0), day(1), 1.0), ("A", "x", "m", day(0), day(2), 22.0), ("A", "x", "m", day(1), day(2), 19.0),
         ("A", "x", "m", day(2), day(2), 99.0), ("A", "x", "m", day(2), day(4), 36.0), ("A", "x", "m", day(2), day(3), 5.0)],
        "store_id string, sku_id string, model string, origin date, date date, yhat double")
    got = {r.date: r for r in rolling_accuracy(log, actual, SPEC, days=3).collect()}
    assert set(got) == {day(1), day(2), day(4)}
    assert (got[day(1)].mae, got[day(1)].mape, got[day(1)].bias) == (1.0, None, 1.0)
    assert (got[day(2)].n, got[day(2)].mae, got[day(2)].bias, got[day(2)].mape) == (2, 1.0, 0.0, 5.0)  # the forecast of day 1, not 0 or 2
    assert (got[day(4)].n, got[day(4)].mae) == (2, 3.5) and abs(got[day(4)].tracking - 5 / 7) < 1e-12
    assert rolling_accuracy(log, actual, SPEC, days=3, lead=2).where("date = '2024-01-03'").first().bias == 2.0


def test_template_must_match(spark):
    filled = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 2.0)], "record_ID string, yhat double")
    require_template(filled, filled)
    with pytest.raises(ValueError, match=r"b \(2 for 1\), c \(0 for 1\)"):
        require_template(filled, spark.createDataFrame([("a",), ("b",), ("c",)], "record_ID string"))


def test_stored_hybrid_forecasts_alike(spark, panel, tmp_path):
    df = random_panel(panel, days=80)
    model = HybridForecaster(minRows=25, rounds=3, order=[1, 0, 0]).fit(df)
    asked = df.groupBy("store_id", "sku_id").agg(F.lit(4).alias("horizon"))
    want = sorted(map(tuple, model.transform(asked).collect()))
    assert len(want) == 16
    model.save(str(tmp_path / "model"))
    fresh = spark.newSession()
    again = HybridForecast.load(str(tmp_path / "model"))
    assert sorted(map(tuple, again.transform(asked).collect())) == want and again.getOrDefault("minRows") == 25
    assert fresh is not spark
    store = Registry(spark, str(tmp_path / "registry"))
    store.register("h", "hybrid")
    assert store.save_model("h", model, str(tmp_path / "stage"))
    assert sorted(map(tuple, store.load_model("h").transform(asked).collect())) == want
    assert isinstance(PipelineModel.load(str(tmp_path / "stage")).stages[0], HybridForecast)
