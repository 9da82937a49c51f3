"""Fitted models and the registry. Model fits have no SQL twin; what follows from data alone has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.forecast import arima, hybrid, pooled, residual
from panelcast.forecast.estimator import HybridForecaster
from panelcast.operators import registry as reg
from panelcast.operators.alignment import attach_forecasts
from panelcast.operators.features import tail_windows
from panelcast.operators.scaling import fit_minmax
from panelcast.operators.splits import hybrid_rule, sequence_rule, split_series, split_windows
from panelcast.plans.catalogue.base import PANEL, daily, query, shown, sql, table, totals
from panelcast.plans.catalogue.features import BY, as_text, text_of
from panelcast.plans.catalogue.forecasts import STEP_LIST, STEPS_SQL, split
from panelcast.plans.training import future_forecast, generate_submission, train_and_backtest
from panelcast.session import workspace, written
from panelcast.spec import keyed

KEY = ["store_id", "sku_id"]
SEQ = 30
STEPS = 30


def windows(spark: SparkSession, sf: str) -> DataFrame:
    return split_windows(daily(spark, sf), PANEL, SEQ, sequence_rule(SEQ))


def scalers(rows: DataFrame) -> DataFrame:
    return fit_minmax(split_series(rows, PANEL, sequence_rule(SEQ)), PANEL, ~F.col("is_test"))


def training_part(spark: SparkSession, sf: str) -> DataFrame:
    return split_series(daily(spark, sf), PANEL, hybrid_rule()).where(~F.col("is_test")).select(*PANEL.columns)


@query("M1_windows_gbt")
def sequence_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Back-test of boosted trees trained on the pooled windows."""
    rows = written(windows(spark, sf), "windows")
    model = pooled.fit_sequence_model(rows, SEQ)
    return pooled.predict_windows(model, rows.where("is_test"), PANEL)


@query("M2_windows_linear")
def linear_fit(spark: SparkSession, sf: str) -> DataFrame:
    rows = written(windows(spark, sf), "windows")
    model = pooled.fit_sequence_model(rows, SEQ, kind="linear")
    return pooled.predict_windows(model, rows.where("is_test"), PANEL)


@query("M3_recursive")
def recursive(spark: SparkSession, sf: str) -> DataFrame:
    """Thirty steps ahead for every series by repeated one-step predictions of the trees."""
    rows = written(daily(spark, sf), "daily")
    model = pooled.fit_sequence_model(split_windows(rows, PANEL, SEQ, sequence_rule(SEQ)), SEQ)
    state = pooled.contexts(tail_windows(rows, PANEL, SEQ, pad=False), scalers(rows), PANEL)
    return pooled.sequence_forecast(model, state, PANEL, STEPS)


@query("M1_windows_network")
def network_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Back-test of the recurrent network trained on the pooled windows."""
    rows = written(windows(spark, sf), "windows")
    model = pooled.fit_sequence_model(rows, SEQ, kind="network", max_iter=6, batch_size=128)
    return pooled.predict_windows(model, rows.where("is_test"), PANEL)


@query("M3_recursive_network")
def recursive_network(spark: SparkSession, sf: str) -> DataFrame:
    """Thirty steps ahead for every series by repeated one-step predictions of the network."""
    rows = written(daily(spark, sf), "daily")
    model = pooled.fit_sequence_model(
        split_windows(rows, PANEL, SEQ, sequence_rule(SEQ)), SEQ, kind="network", max_iter=6, batch_size=128)
    state = pooled.contexts(tail_windows(rows, PANEL, SEQ, pad=False), scalers(rows), PANEL)
    return pooled.sequence_forecast(model, state, PANEL, STEPS)


@query("M3_recursive_linear")
def recursive_linear(spark: SparkSession, sf: str) -> DataFrame:
    rows = written(daily(spark, sf), "daily")
    model = pooled.fit_sequence_model(split_windows(rows, PANEL, SEQ, sequence_rule(SEQ)), SEQ, kind="linear")
    state = pooled.contexts(tail_windows(rows, PANEL, SEQ, pad=False), scalers(rows), PANEL)
    return pooled.sequence_forecast(model, state, PANEL, STEPS)


@query("M4_arima")
def arima_future(spark: SparkSession, sf: str) -> DataFrame:
    params = written(arima.fit_arima(daily(spark, sf), PANEL, (1, 1, 1)), "params")
    return arima.arima_forecast(params, PANEL, STEPS)


@query("M4_arima_walk", sql(
    f"""SELECT store_id, sku_id, 'ARIMA' AS model, step, CAST(last_date + step AS DATE) AS date, level AS yhat
        FROM (SELECT store_id, sku_id, max(date) AS last_date, arg_max(units_sold, date) AS level FROM daily GROUP BY ALL HAVING count(*) >= 3), {STEP_LIST}""",
    ["daily"], doubles=["yhat"], dates=["date"]))
def arima_walk(spark: SparkSession, sf: str) -> DataFrame:
    """The fitter and its fold at order (0,1,0), where the forecast is the last value."""
    return shown(arima.arima_forecast(arima.fit_arima(daily(spark, sf), PANEL, (0, 1, 0), min_rows=3), PANEL, STEPS))


@query("M11_info_walk", sql(
    """SELECT store_id, sku_id, n, sse / n AS sigma2, 2 + n * (ln(2 * pi() * greatest(sse / n, 1e-12)) + 1) AS aic,
              ln(n) + n * (ln(2 * pi() * greatest(sse / n, 1e-12)) + 1) AS bic
       FROM (SELECT store_id, sku_id, count(d) AS n, sum(d * d) AS sse
             FROM (SELECT *, units_sold - lag(units_sold) OVER (PARTITION BY store_id, sku_id ORDER BY date) AS d FROM daily)
             GROUP BY ALL HAVING count(*) >= 3)""", ["daily"], doubles=["sigma2", "aic", "bic"]))
def info_walk(spark: SparkSession, sf: str) -> DataFrame:
    """Variance and information criteria at order (0,1,0), whose closed form is known."""
    params = arima.fit_arima(daily(spark, sf), PANEL, (0, 1, 0), min_rows=3).where("status = 'fitted'")
    return shown(params.select(*KEY, (F.col("n_train") - 1).alias("n"), "sigma2", "aic", "bic"))


@query("M4_exact_ar1", sql(
    """SELECT store_id, sku_id, n, round((lo + hi) / 2, 5) + 0 AS phi,
              round((a - b * (lo + hi) + c * ((lo + hi) / 2) ** 2) / n, 4) AS sigma2
       FROM halved WHERE i = 60""", ["daily"], recursive=True,
    moved="SELECT *, units_sold - lag(units_sold) OVER (PARTITION BY store_id, sku_id ORDER BY date) AS x FROM daily",
    pairs="SELECT *, lag(x) OVER (PARTITION BY store_id, sku_id ORDER BY date) AS before FROM moved WHERE x IS NOT NULL",
    sums="""SELECT store_id, sku_id, count(*) AS n, sum(x * x) AS a, sum(x * before) AS b,
                   sum(x * x) - arg_min(x, date) ** 2 - arg_max(x, date) ** 2 AS c FROM pairs GROUP BY ALL HAVING count(*) >= 9""",
    # The slope of the likelihood is a cubic with one root between -1 and 1, negative before it and positive past it.
    halved="""SELECT *, CAST(-1 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi, 0 AS i FROM sums UNION ALL
              SELECT store_id, sku_id, n, a, b, c, CASE WHEN slope < 0 THEN mid ELSE lo END, CASE WHEN slope < 0 THEN hi ELSE mid END, i + 1
              FROM (SELECT *, n * (c * mid - b) * (1 - mid * mid) + mid * (a - 2 * b * mid + c * mid * mid) AS slope
                    FROM (SELECT *, (lo + hi) / 2 AS mid FROM halved)) WHERE i < 60"""))
def exact_autoregression(spark: SparkSession, sf: str) -> DataFrame:
    """Maximum-likelihood coefficient and variance at order (1,1,0), whose slope is a cubic that SQL can solve."""
    params = arima.fit_arima(daily(spark, sf), PANEL, (1, 1, 0), min_rows=10).where("status = 'fitted'")
    return params.select(
        *KEY, (F.col("n_train") - 1).alias("n"), (F.round(F.col("ar")[0], 5) + 0).alias("phi"), F.round("sigma2", 4).alias("sigma2"))


@query("M9_panel_fit", sql(
    "SELECT status, count(*) AS n_series FROM (SELECT CASE WHEN count(*) < 20 THEN 'skipped' ELSE 'fitted' END AS status FROM history GROUP BY store_id, sku_id) GROUP BY status",
    ["placed"], **STEPS_SQL))
def panel_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Number of series by fit status."""
    return arima.fit_counts(arima.fit_arima(training_part(spark, sf), PANEL, (1, 1, 1), min_rows=20))


@query("M11_model_info")
def model_info(spark: SparkSession, sf: str) -> DataFrame:
    return arima.model_info(arima.fit_arima(training_part(spark, sf), PANEL), PANEL)


@query("F6_residual_lags", sql(
    f"""SELECT store_id, sku_id, date, x AS target, {text_of("w")} AS "window"
        FROM (SELECT *, list(x) OVER ({BY} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS w
              FROM (SELECT *, units_sold - lag(units_sold) OVER ({BY}) AS x FROM daily) WHERE x IS NOT NULL)
        WHERE len(w) = 10""", ["daily"], doubles=["target"], dates=["date"]))
def residual_lags(spark: SparkSession, sf: str) -> DataFrame:
    """Lag matrix of the residuals of order (0,1,0), whose fit has nothing to estimate."""
    params = arima.fit_arima(daily(spark, sf), PANEL, (0, 1, 0))
    rows = residual.residual_windows(arima.residuals(params, PANEL), PANEL)
    return shown(rows.select(*KEY, "date", "target", as_text(F.col("window")).alias("window")))


@query("M6_residual")
def boosted_residuals(spark: SparkSession, sf: str) -> DataFrame:
    """In-sample correction of every residual window by the trees of its series."""
    params = written(arima.fit_arima(training_part(spark, sf), PANEL, (1, 1, 1), min_rows=20), "params")
    rows = written(residual.residual_windows(arima.residuals(params, PANEL), PANEL), "residual_windows")
    return residual.corrected(rows, residual.fit_boosters(rows, PANEL), PANEL)


@query("M8_hybrid")
def hybrid_future(spark: SparkSession, sf: str) -> DataFrame:
    """ARIMA plus recursive residual corrections, thirty steps for every series."""
    model = hybrid.fit_hybrid(training_part(spark, sf), PANEL)
    return hybrid.hybrid_forecast(model, PANEL, STEPS)


@query("M13_single_series")
def single(spark: SparkSession, sf: str) -> DataFrame:
    """Both models on the daily totals, judged on the same dates."""
    from panelcast.plans.catalogue.base import SINGLE

    rows, spec = keyed(totals(spark, sf), SINGLE)
    return train_and_backtest(rows, spec, SEQ).metrics


@query("M14_panel_training")
def panel_training(spark: SparkSession, sf: str) -> DataFrame:
    return train_and_backtest(daily(spark, sf), PANEL, SEQ).metrics


@query("M15_future")
def panel_future(spark: SparkSession, sf: str) -> DataFrame:
    trained = train_and_backtest(daily(spark, sf), PANEL, SEQ)
    return future_forecast(trained, trained.clean, PANEL, STEPS)


@query("M17_submission_models")
def model_submission(spark: SparkSession, sf: str) -> DataFrame:
    """The best model fills one record per test row."""
    history, test = split(spark, sf)
    trained = train_and_backtest(history, PANEL, SEQ)
    rows = test.drop("units_sold").withColumn("record_ID", F.concat_ws("_", *KEY, F.col("date").cast("string")))
    return generate_submission(trained, trained.clean, rows, PANEL)


@query("M19_runs")
def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Both losses after each boosting round, up to the round at which patience ran out."""
    model = pooled.fit_sequence_model(windows(spark, sf), SEQ)
    rows = [("Sequence", i, float(a), float(b)) for i, (a, b) in enumerate(zip(model.losses, model.val_losses))]
    return spark.createDataFrame(rows, "model string, iteration int, loss double, val_loss double")


# ---- registry: each user of the event log is a model, registered by its first event and updated by the others


def registry_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    name = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    first = rows.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("_first"))
    return rows.join(first, "user_id").select(
        F.lpad(F.col("event_id").cast("string"), 20, "0").alias("event_id"),
        F.col("ts").alias("at"),
        F.when(F.col("event_id") == F.col("_first.event_id"), "register")
        .when(F.col("event_type") == "error", "remove").otherwise("update").alias("action"),
        name.alias("name"), F.col("event_type").alias("model_type"), F.lit("1.0.0").alias("version"),
        F.create_map(F.col("event_type"), F.col("value")).alias("metrics"),
        F.create_map(F.lit("props"), F.col("props")).alias("config"),
        F.array("event_type").alias("tags"), F.lit(None).cast("string").alias("file_path"), F.lit("").alias("description"),
    )


LIVE = {
    "log": """SELECT event_id, ts, 'user_' || user_id AS name, event_type, value,
                     CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 'register'
                          WHEN event_type = 'error' THEN 'remove' ELSE 'update' END AS action FROM events""",
    "epochs": "SELECT *, sum(CASE WHEN action <> 'update' THEN 1 ELSE 0 END) OVER (PARTITION BY name ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM log",
    "recent": "SELECT * FROM (SELECT *, max(e) OVER (PARTITION BY name) AS last FROM epochs) WHERE e = last",
    "live": "SELECT * FROM (SELECT *, count(*) FILTER (WHERE action = 'remove') OVER (PARTITION BY name) AS gone FROM recent) WHERE gone = 0",
    "kept": "SELECT name, event_type AS model_type, ts AS created_at FROM live WHERE action = 'register'",
}


@query("R2_models", sql("SELECT name, model_type, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM kept", **LIVE))
def registered(spark: SparkSession, sf: str) -> DataFrame:
    found = reg.models(registry_events(spark, sf))
    return found.select("name", "model_type", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("R3_latest", sql(
    "SELECT model_type, arg_max(name, created_at) AS name FROM kept GROUP BY model_type", **LIVE))
def latest(spark: SparkSession, sf: str) -> DataFrame:
    return reg.latest_by_type(registry_events(spark, sf)).select("model_type", "name")


def _always_live(spark: SparkSession, sf: str) -> DataFrame:
    """The same log without removals."""
    action = F.when(F.col("action") == "remove", "update").otherwise(F.col("action"))
    return registry_events(spark, sf).withColumn("action", action)


@query("R4_merge", "SELECT 'user_' || user_id AS name, event_type AS key, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def merge(spark: SparkSession, sf: str) -> DataFrame:
    """Newest value per model and metric."""
    return reg.merged_entries(_always_live(spark, sf), "metrics")


@query("R5_tags", """SELECT DISTINCT 'user_' || e.user_id AS name, f.event_type AS model_type
                     FROM events e JOIN (SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1) f USING (user_id) WHERE e.event_type = 'purchase'""")
def tags(spark: SparkSession, sf: str) -> DataFrame:
    return reg.with_tag(_always_live(spark, sf), "purchase").select("name", "model_type")


@query("R7_save_load")
def save_load(spark: SparkSession, sf: str) -> DataFrame:
    """A linear window model registered, stored, loaded again and applied."""
    rows = written(windows(spark, sf), "windows")
    trained = pooled.fit_sequence_model(rows, SEQ, kind="linear")
    store = reg.Registry(spark, workspace(spark, "registry"))
    store.register("windows", "sequence", metrics={"loss": trained.losses[-1]})
    store.save_model("windows", trained.model, workspace(spark, "window_model"))
    loaded = pooled.TrainedModel(store.load_model("windows"), SEQ, 0.0)
    return pooled.predict_windows(loaded, rows.where("is_test"), PANEL)


@query("R7_hybrid")
def hybrid_save_load(spark: SparkSession, sf: str) -> DataFrame:
    """The hybrid as an estimator: fitted, registered, stored, loaded again and applied."""
    train = training_part(spark, sf)
    store = reg.Registry(spark, workspace(spark, "registry"))
    store.register("hybrid", "hybrid")
    store.save_model("hybrid", HybridForecaster(rounds=20).fit(train), workspace(spark, "hybrid_model"))
    asked = train.groupBy(*KEY).agg(F.lit(STEPS).alias("horizon"))
    return store.load_model("hybrid").transform(asked)


@query("M7_corrections")
def corrections_ahead(spark: SparkSession, sf: str) -> DataFrame:
    """Residual corrections alone, thirty steps for every series, with the size of the residuals they continue."""
    model = hybrid.fit_hybrid(training_part(spark, sf), PANEL)
    ahead = residual.corrections(model.boosters, model.params, model.scalers, PANEL, STEPS)
    spread = model.params.where("status = 'fitted'").select(*KEY, F.sqrt("sigma2").alias("resid_std"))
    return ahead.join(spread, KEY)


@query("M10_panel_forecasts")
def panel_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid predictions of every series' own test rows, next to what happened."""
    parts = split_series(daily(spark, sf), PANEL, hybrid_rule())
    model = hybrid.fit_hybrid(parts.where(~F.col("is_test")).select(*PANEL.columns), PANEL)
    held = parts.where("is_test")
    ahead = hybrid.hybrid_forecast(model, PANEL, horizon=held.groupBy(*KEY).agg(F.count(F.lit(1)).alias("horizon")))
    return attach_forecasts(held, ahead, PANEL).select(*PANEL.columns, "yhat")
