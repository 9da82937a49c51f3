"""Closed-form forecasters, alignment joins, evaluation and submissions that SQL can restate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.forecast import closed_form as cf
from panelcast.operators import alignment as al
from panelcast.operators import evaluate as ev
from panelcast.operators.features import tail_windows
from panelcast.operators.splits import SplitRule, hybrid_rule, split_series
from panelcast.plans.catalogue.base import PANEL, daily, query, shown, sql
from panelcast.plans.catalogue.features import BY, as_text, split_of, text_of
from panelcast.plans.training import finish_submission
from panelcast.session import written

KEY = ["store_id", "sku_id"]
STEPS = 30

# ---- inputs: history (first 80 % of each series), test rows after it, and the part a model was fitted on

STEPS_SQL = {
    "parts": f"SELECT store_id, sku_id, date, units_sold, pos, n_rows, {split_of(10)} AS split_idx FROM placed WHERE n_rows >= 20",
    "history": "SELECT store_id, sku_id, date, units_sold, pos, split_idx AS n_rows FROM parts WHERE pos < split_idx",
    "test": "SELECT store_id, sku_id, date, units_sold, CAST(pos - split_idx + 1 AS INTEGER) AS step FROM parts WHERE pos >= split_idx",
    "fitted": f"SELECT store_id, sku_id, date, units_sold, pos FROM history WHERE pos < {split_of(10)}",
}


def params_sql(source: str) -> str:
    """AR(1) with constant by least squares, and the last level and date."""
    return f"""SELECT store_id, sku_id, coalesce(regr_slope(units_sold, prev), 0) AS phi, coalesce(regr_intercept(units_sold, prev), avg(units_sold)) AS const,
                      count(prev) AS n_pairs, max(date) AS last_date, arg_max(units_sold, date) AS level
               FROM (SELECT *, lag(units_sold) OVER (PARTITION BY store_id, sku_id ORDER BY date) AS prev FROM {source}) GROUP BY ALL"""


def ar1_sql(h: str) -> str:
    return f"pow(phi, {h}) * level + CASE WHEN abs(1 - phi) < 1e-12 THEN const * {h} ELSE const * (1 - pow(phi, {h})) / (1 - phi) END"


STEP_LIST = f"(SELECT CAST(unnest(range(1, {STEPS + 1})) AS INTEGER) AS step)"


def split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    parts = split_series(daily(spark, sf), PANEL, hybrid_rule())
    return (
        parts.where(~F.col("is_test")).select(*PANEL.columns),
        parts.where("is_test").select(*PANEL.columns),
    )


def horizons(test: DataFrame) -> DataFrame:
    """Number of test rows of each series."""
    return test.groupBy(*KEY).agg(F.count(F.lit(1)).alias("horizon"))


def backtest(spark: SparkSession, sf: str) -> DataFrame:
    """Both closed forms and their mean on the test rows."""
    history, test = split(spark, sf)
    steps = horizons(test)
    naive = al.attach_forecasts(test, cf.naive_forecast(history, PANEL, steps), PANEL)
    ar1 = al.attach_forecasts(test, cf.ar1_forecast(history, PANEL, steps), PANEL)
    on = [*KEY, "date"]
    long = al.ensemble(naive, ar1, on)
    return al.align_actuals(test, long, PANEL)


BACKTEST_SQL = {
    **STEPS_SQL,
    "params": params_sql("history"),
    "two": f"SELECT t.store_id, t.sku_id, t.date, t.units_sold AS y, p.level AS a, {ar1_sql('t.step')} AS b FROM test t JOIN params p USING (store_id, sku_id)",
    "backtest": """SELECT store_id, sku_id, date, y, 'Sequence' AS model, a AS yhat FROM two UNION ALL
                   SELECT store_id, sku_id, date, y, 'Hybrid', b FROM two UNION ALL SELECT store_id, sku_id, date, y, 'Ensemble', (a + b) / 2 FROM two""",
    "metrics": """SELECT model, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg(abs((y - yhat) / (abs(y) + 1e-8))) * 100 AS mape,
                         count(*) AS n_samples FROM backtest GROUP BY model""",
}


@query("M18_naive", sql(
    f"""SELECT store_id, sku_id, 'Naive' AS model, step, CAST(last_date + step AS DATE) AS date, level AS yhat
        FROM (SELECT store_id, sku_id, max(date) AS last_date, arg_max(units_sold, date) AS level FROM daily GROUP BY ALL), {STEP_LIST}""",
    ["daily"], doubles=["yhat"], dates=["date"]))
def naive(spark: SparkSession, sf: str) -> DataFrame:
    return shown(cf.naive_forecast(daily(spark, sf), PANEL, STEPS))


@query("M4_ar1", sql(
    f"SELECT store_id, sku_id, 'AR1' AS model, step, CAST(last_date + step AS DATE) AS date, {ar1_sql('step')} AS yhat FROM params, {STEP_LIST}",
    ["daily"], doubles=["yhat"], dates=["date"], params=params_sql("daily")))
def ar1(spark: SparkSession, sf: str) -> DataFrame:
    return shown(cf.ar1_forecast(daily(spark, sf), PANEL, STEPS))


@query("M4_diff_ar1", sql(
    f"""SELECT store_id, sku_id, 'DiffAR1' AS model, step, CAST(last_date + step AS DATE) AS date,
               level + change * CASE WHEN abs(1 - phi) < 1e-12 THEN step ELSE phi * (1 - pow(phi, step)) / (1 - phi) END AS yhat
        FROM (SELECT store_id, sku_id, coalesce(sum(d * p) / nullif(sum(p * p), 0), 0) AS phi, max(date) AS last_date, arg_max(units_sold, date) AS level, coalesce(arg_max(d, date), 0) AS change
              FROM (SELECT *, lag(d) OVER (PARTITION BY store_id, sku_id ORDER BY date) AS p
                    FROM (SELECT *, units_sold - lag(units_sold) OVER (PARTITION BY store_id, sku_id ORDER BY date) AS d FROM daily)) GROUP BY store_id, sku_id), {STEP_LIST}""",
    ["daily"], doubles=["yhat"], dates=["date"]))
def diff_ar1(spark: SparkSession, sf: str) -> DataFrame:
    return shown(cf.diff_ar1_forecast(daily(spark, sf), PANEL, STEPS))


@query("M5_residuals", sql(
    """SELECT store_id, sku_id, date, units_sold - const - phi * prev AS resid
       FROM (SELECT *, lag(units_sold) OVER (PARTITION BY store_id, sku_id ORDER BY date) AS prev FROM daily) JOIN params USING (store_id, sku_id) WHERE prev IS NOT NULL""",
    ["daily"], doubles=["resid"], dates=["date"], params=params_sql("daily")))
def ar1_errors(spark: SparkSession, sf: str) -> DataFrame:
    return shown(cf.ar1_residuals(daily(spark, sf), PANEL))


@query("P11_clip", sql(
    f"SELECT store_id, sku_id, step, greatest(2 * level - ({ar1_sql('step')}) - 60, 0) AS units_sold FROM params, {STEP_LIST}",
    ["daily"], doubles=["units_sold"], params=params_sql("daily")))
def clip(spark: SparkSession, sf: str) -> DataFrame:
    """A combination that often turns negative, clipped at zero."""
    a, b = cf.naive_forecast(daily(spark, sf), PANEL, STEPS), cf.ar1_forecast(daily(spark, sf), PANEL, STEPS)
    both = al.side_by_side(a, b, [*KEY, "step"])
    return shown(both.select(*KEY, "step", F.greatest(2 * F.col("a") - F.col("b") - 60, F.lit(0.0)).alias("units_sold")))


@query("W3_position", sql(
    "SELECT store_id || '_' || sku_id || '_' || (step - 1) AS record_id, date, step FROM test", ["placed"], dates=["date"], **STEPS_SQL))
def position(spark: SparkSession, sf: str) -> DataFrame:
    _, test = split(spark, sf)
    rows = al.numbered(test, PANEL)
    return shown(rows.select(F.concat_ws("_", *KEY, (F.col("step") - 1).cast("string")).alias("record_id"), "date", "step"))


@query("J1_history", sql(
    """SELECT store_id, sku_id, n_test, n_train, last_train_date, CASE WHEN n_train IS NULL THEN 'no history' ELSE 'ok' END AS status
       FROM (SELECT store_id, sku_id, count(*) AS n_test FROM test GROUP BY ALL)
       LEFT JOIN (SELECT store_id, sku_id, count(*) AS n_train, max(date) AS last_train_date FROM history WHERE store_id <> 'S4' GROUP BY ALL) USING (store_id, sku_id)""",
    ["placed"], dates=["last_train_date"], **STEPS_SQL))
def history_join(spark: SparkSession, sf: str) -> DataFrame:
    history, test = split(spark, sf)
    return shown(al.history_of(test, history.where("store_id <> 'S4'"), PANEL))


@query("X6_context", sql(
    f"""SELECT store_id, sku_id, n_test, CAST(least(n, 30) AS INTEGER) AS n_history,
               {text_of("CASE WHEN len(w) < 30 THEN list_concat(list_transform(range(30 - len(w)), lambda i: m), w) ELSE w END")} AS "window"
        FROM (SELECT *, list(units_sold) OVER ({BY} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS w, avg(units_sold) OVER ({BY} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS m,
                     row_number() OVER (PARTITION BY store_id, sku_id ORDER BY date DESC) AS back, count(*) OVER (PARTITION BY store_id, sku_id) AS n FROM history)
        JOIN (SELECT store_id, sku_id, count(*) AS n_test FROM test GROUP BY ALL) USING (store_id, sku_id) WHERE back = 1""", ["placed"], **STEPS_SQL))
def context(spark: SparkSession, sf: str) -> DataFrame:
    """Last window of the history of each series asked for, and how many rows are asked."""
    history, test = split(spark, sf)
    asked = test.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_test"))
    rows = tail_windows(history, PANEL, 30).join(asked, KEY)
    return rows.select(*KEY, "n_test", "n_history", as_text(F.col("window")).alias("window"))


MISSING = sql("SELECT DISTINCT store_id, sku_id FROM test WHERE store_id = 'S4'", ["placed"], **STEPS_SQL)


@query("U3_without_history", MISSING)
def no_history(spark: SparkSession, sf: str) -> DataFrame:
    history, test = split(spark, sf)
    return al.without_history(test, history.where("store_id <> 'S4'"), PANEL)


@query("P12_missing_groups", MISSING)
def missing_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Series whose test rows got no forecast."""
    from panelcast.plans.training import unpredicted

    history, test = split(spark, sf)
    known = cf.naive_forecast(history.where("store_id <> 'S4'"), PANEL, horizons(test))
    return unpredicted(al.attach_forecasts(test, known, PANEL), PANEL)


def fitted_part(history: DataFrame) -> DataFrame:
    return split_series(history, PANEL, SplitRule(min_train=10)).where(~F.col("is_test")).select(*PANEL.columns)


GAP = """SELECT store_id, sku_id, n_train, n_fitted, greatest(n_train - n_fitted, 0) AS gap
         FROM (SELECT store_id, sku_id, count(*) AS n_train FROM history GROUP BY ALL) JOIN (SELECT store_id, sku_id, count(*) AS n_fitted FROM fitted GROUP BY ALL) USING (store_id, sku_id)"""


@query("J3_gap", sql("SELECT * FROM gaps", ["placed"], **STEPS_SQL, gaps=GAP))
def gap(spark: SparkSession, sf: str) -> DataFrame:
    history, _ = split(spark, sf)
    return al.forecast_gap(history, fitted_part(history), PANEL)


PAST_GAP = {**STEPS_SQL, "gaps": GAP, "params": params_sql("fitted"),
            "needs": "SELECT store_id, sku_id, count(*) AS n_test FROM test GROUP BY ALL"}


def past_gap(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """AR(1) and carried level fitted before the gap, taken past it, and the test rows."""
    history, test = split(spark, sf)
    fitted = fitted_part(history)
    sizes = test.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_test"))
    needs = written(al.forecast_gap(history, fitted, PANEL).join(sizes, KEY), "needs")
    steps = int(needs.agg(F.max(F.col("gap") + F.col("n_test"))).first()[0] or 0)
    forms = (cf.naive_forecast(fitted, PANEL, steps), cf.ar1_forecast(fitted, PANEL, steps))
    return (*(al.past_the_gap(f, needs, PANEL) for f in forms), test)


@query("M16_gap", sql(
    f"""SELECT store_id, sku_id, 'AR1' AS model, CAST(s.step AS INTEGER) AS step, {ar1_sql("(gap + s.step)")} AS yhat
        FROM gaps JOIN params USING (store_id, sku_id) JOIN test s USING (store_id, sku_id)""", ["placed"], doubles=["yhat"], **PAST_GAP))
def gap_forecast(spark: SparkSession, sf: str) -> DataFrame:
    _, aligned, _ = past_gap(spark, sf)
    return shown(aligned.drop("date"))


@query("M17_submission", sql(
    f"""SELECT store_id || '_' || sku_id || '_' || (s.step - 1) AS "record_ID", greatest((level + {ar1_sql("(gap + s.step)")}) / 2, 0) AS units_sold
        FROM gaps JOIN params USING (store_id, sku_id) JOIN test s USING (store_id, sku_id)""", ["placed"], doubles=["units_sold"], **PAST_GAP))
def submission(spark: SparkSession, sf: str) -> DataFrame:
    level, ar, test = past_gap(spark, sf)
    pair = al.side_by_side(level, ar, [*KEY, "step"], ("sequence", "hybrid"))
    chosen = al.select_predictions(pair, al.ENSEMBLE)
    named = al.numbered(test, PANEL).withColumn("record_ID", F.concat_ws("_", *KEY, (F.col("step") - 1).cast("string"))).drop("step")
    return shown(finish_submission(written(al.attach_forecasts(named, chosen, PANEL), "filled"), PANEL))


@query("J4_attach", sql(
    "SELECT store_id, sku_id, date, step, level AS yhat FROM test JOIN params USING (store_id, sku_id)", ["placed"],
    doubles=["yhat"], dates=["date"], **STEPS_SQL, params=params_sql("history")))
def attach(spark: SparkSession, sf: str) -> DataFrame:
    history, test = split(spark, sf)
    rows = al.attach_forecasts(test, cf.naive_forecast(history, PANEL, horizons(test)), PANEL)
    return shown(rows.select(*KEY, "date", "step", "yhat"))


@query("J5_align", sql("SELECT * FROM backtest", ["placed"], doubles=["y", "yhat"], dates=["date"], **BACKTEST_SQL))
def align(spark: SparkSession, sf: str) -> DataFrame:
    return shown(backtest(spark, sf))


@query("J6_select", sql(
    f"""SELECT store_id, sku_id, step, level AS sequence, CASE WHEN store_id <> 'S4' THEN {ar1_sql('step')} END AS hybrid,
               CASE WHEN store_id <> 'S4' THEN {ar1_sql('step')} ELSE level END AS yhat FROM params, {STEP_LIST}""",
    ["daily"], doubles=["sequence", "hybrid", "yhat"], params=params_sql("daily")))
def select(spark: SparkSession, sf: str) -> DataFrame:
    """The second model is missing for one store, where the first stands in."""
    rows = daily(spark, sf)
    a, b = cf.naive_forecast(rows, PANEL, STEPS), cf.ar1_forecast(rows.where("store_id <> 'S4'"), PANEL, STEPS)
    return shown(al.select_predictions(al.side_by_side(a, b, [*KEY, "step"], ("sequence", "hybrid")), al.HYBRID))


FUTURE = f"""SELECT store_id, sku_id, step, CAST(last_date + step AS DATE) AS date, 'Sequence' AS model, level AS yhat FROM params, {STEP_LIST} UNION ALL
             SELECT store_id, sku_id, step, CAST(last_date + step AS DATE), 'Hybrid', {ar1_sql('step')} FROM params, {STEP_LIST} UNION ALL
             SELECT store_id, sku_id, step, CAST(last_date + step AS DATE), 'Ensemble', (level + {ar1_sql('step')}) / 2 FROM params, {STEP_LIST}"""
FUTURE_SQL = {"params": params_sql("daily"), "future": FUTURE}


def future(spark: SparkSession, sf: str) -> DataFrame:
    rows = daily(spark, sf)
    on = [*KEY, "step", "date"]
    return al.ensemble(cf.naive_forecast(rows, PANEL, STEPS), cf.ar1_forecast(rows, PANEL, STEPS), on)


@query("M12_ensemble", sql("SELECT * FROM future", ["daily"], doubles=["yhat"], dates=["date"], **FUTURE_SQL))
def ensemble(spark: SparkSession, sf: str) -> DataFrame:
    return shown(future(spark, sf))


@query("A14_metrics", sql("SELECT * FROM metrics", ["placed"], doubles=["mae", "rmse", "mape"], **BACKTEST_SQL))
def metrics(spark: SparkSession, sf: str) -> DataFrame:
    return shown(ev.error_metrics(backtest(spark, sf)))


@query("A14_metrics_series", sql(
    """SELECT model, store_id, sku_id, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg(abs((y - yhat) / (abs(y) + 1e-8))) * 100 AS mape,
              count(*) AS n_samples FROM backtest GROUP BY ALL""", ["placed"], doubles=["mae", "rmse", "mape"], **BACKTEST_SQL))
def metrics_series(spark: SparkSession, sf: str) -> DataFrame:
    return shown(ev.error_metrics(backtest(spark, sf), ("model", *KEY)))


@query("A15_compare", sql(
    "SELECT *, CAST(row_number() OVER (ORDER BY mape, model) AS INTEGER) AS rank FROM metrics", ["placed"], doubles=["mae", "rmse", "mape"], **BACKTEST_SQL))
def compare(spark: SparkSession, sf: str) -> DataFrame:
    return shown(ev.compare_models(ev.error_metrics(backtest(spark, sf)), "MAPE"))


@query("A16_best", sql(
    """SELECT arg_min(model, rmse) AS best_model, min(rmse) AS best_value, max(rmse) AS worst_value,
              round_even(CASE WHEN max(rmse) > 0 THEN (max(rmse) - min(rmse)) / max(rmse) * 100 ELSE 0 END, 1) AS improvement_pct FROM metrics""",
    ["placed"], doubles=["best_value", "worst_value"], **BACKTEST_SQL))
def best(spark: SparkSession, sf: str) -> DataFrame:
    return shown(ev.best_model(ev.error_metrics(backtest(spark, sf))))


@query("A17_choice", sql(
    "SELECT arg_min(model, rmse) AS model FROM metrics WHERE model <> 'Ensemble'", ["placed"], **BACKTEST_SQL))
def choice(spark: SparkSession, sf: str) -> DataFrame:
    scored = ev.error_metrics(backtest(spark, sf)).where("model <> 'Ensemble'")
    return ev.best_model(scored).select(F.col("best_model").alias("model"))


@query("A18_mean_forecast", sql("SELECT model, step, avg(yhat) AS mean_yhat FROM future GROUP BY ALL", ["daily"], doubles=["mean_yhat"], **FUTURE_SQL))
def mean_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return shown(ev.mean_forecast(future(spark, sf)))


@query("A19_summary", sql(
    "SELECT count(*) AS n, avg(yhat) AS mean_yhat, max(yhat) AS max_yhat, min(yhat) AS min_yhat FROM future WHERE model = 'Ensemble'",
    ["daily"], doubles=["mean_yhat", "max_yhat", "min_yhat"], **FUTURE_SQL))
def forecast_summary(spark: SparkSession, sf: str) -> DataFrame:
    return shown(ev.forecast_summary(future(spark, sf)))


@query("K3_pivot", sql(
    """SELECT strftime(date, '%Y-%m-%d') AS "Date", avg(yhat) FILTER (WHERE model = 'Sequence') AS "Sequence", avg(yhat) FILTER (WHERE model = 'Hybrid') AS "Hybrid",
              avg(yhat) FILTER (WHERE model = 'Ensemble') AS "Ensemble" FROM future GROUP BY 1""", ["daily"], **FUTURE_SQL)
    .replace("SELECT * FROM answer", 'SELECT "Date", round_even("Sequence", 2) AS "Sequence", round_even("Hybrid", 2) AS "Hybrid", round_even("Ensemble", 2) AS "Ensemble" FROM answer'))
def pivot(spark: SparkSession, sf: str) -> DataFrame:
    return al.forecast_table(future(spark, sf))


@query("A20_analytics", sql(
    """SELECT count(DISTINCT model) AS models_evaluated, (SELECT count(DISTINCT store_id) FROM daily) AS models_trained,
              (SELECT sum(units_sold) FROM daily) AS total_training_time, count(DISTINCT model) > 0 AS ready FROM metrics""",
    ["placed"], doubles=["total_training_time"], **BACKTEST_SQL))
def analytics(spark: SparkSession, sf: str) -> DataFrame:
    """Runs are stood in for by daily rows: the store is the model, its units the seconds."""
    runs = daily(spark, sf).select(F.col("store_id").alias("model"), F.col("units_sold").alias("seconds"))
    return shown(ev.run_analytics(runs, ev.error_metrics(backtest(spark, sf))))
