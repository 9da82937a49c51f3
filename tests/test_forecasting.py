import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from panelcast.forecast import arima, hybrid, pooled, residual
from panelcast.forecast import likelihood as lk
from panelcast.forecast.batches import series_starts, whole_series
from panelcast.forecast.recursion import roll_forward
from panelcast.forecast.series_trees import fit_trees
from panelcast.operators import alignment as al
from panelcast.operators import evaluate as ev
from panelcast.operators import splits
from panelcast.plans.training import future_forecast, generate_submission, train_and_backtest
from panelcast.spec import SeriesSpec

SPEC = SeriesSpec()
KEYS = ["store_id", "sku_id"]


def random_panel(panel, stores=2, skus=2, days=120, seed=2):
    rng = np.random.default_rng(seed)
    return panel({(f"S{i}", f"K{j}"): np.maximum(0, rng.normal(rng.uniform(10, 50), 3, days)) for i in range(stores) for j in range(skus)})


def test_css_recovers_parameters():
    rng = np.random.default_rng(0)
    e = rng.normal(size=4000)
    y = np.zeros(4000)
    for t in range(1, 4000):
        y[t] = 2 + 0.6 * y[t - 1] + e[t] + 0.3 * e[t - 1]
    fit = arima.fit_css(y, (1, 0, 1))
    assert abs(fit["ar"][0] - 0.6) < 0.05 and abs(fit["ma"][0] - 0.3) < 0.06 and abs(fit["sigma2"] - 1) < 0.06
    assert abs(fit["const"] - 5) < 0.3


def test_exact_fit_agrees_with_css_on_long_series():
    rng = np.random.default_rng(1)
    ys = []
    for phi, theta, n in ((0.6, 0.3, 3000), (-0.4, 0.5, 2500), (0.2, -0.7, 2800)):
        e, y = rng.normal(size=n), np.zeros(n)
        for t in range(1, n):
            y[t] = phi * y[t - 1] + e[t] + theta * e[t - 1]
        ys.append(y + 5)
    for order in ((1, 0, 1), (1, 0, 0), (0, 0, 1), (2, 0, 1)):
        for y, fit in zip(ys, arima.fit_exact(ys, order)):  # lengths differ
            css = arima.fit_css(y, order)
            assert fit["converged"] and abs(fit["sigma2"] / css["sigma2"] - 1) < 2e-3
            assert abs(fit["const"] - css["const"]) < 0.02
            if order != (2, 0, 1):
                assert np.allclose(np.r_[fit["ar"], fit["ma"]], np.r_[css["ar"], css["ma"]], atol=5e-3)


def dense_likelihood(x, ar, ma):
    """x' S^-1 x and log det S from the covariance matrix of an ARMA process with unit shocks."""
    m, n = 800, len(x)
    psi = np.zeros(m + n)
    psi[0] = 1
    for j in range(1, m + n):
        psi[j] = (ma[j - 1] if j <= len(ma) else 0) + sum(a * psi[j - 1 - i] for i, a in enumerate(ar) if j - 1 - i >= 0)
    cov = np.array([psi[:m] @ psi[h:h + m] for h in range(n)])
    root = np.linalg.cholesky(cov[np.abs(np.arange(n)[:, None] - np.arange(n))])
    u = np.linalg.solve(root, x)
    return u @ u, 2 * np.log(np.diag(root)).sum()


@pytest.mark.parametrize("ar, ma", [([0.5], []), ([], [-0.9]), ([0.5], [0.3]), ([0.5, 0.2], [-0.6]), ([-0.3], [0.4, 0.2])])
def test_likelihood_and_its_slope(ar, ma):
    """Two series of different length in one batch, against the dense covariance and finite differences."""
    rng = np.random.default_rng(3)
    xs = [rng.normal(size=40), rng.normal(size=25)]
    batch = lk._Batch(xs, len(ar), len(ma), False)
    z = np.tile(np.concatenate([lk.to_partial(np.array([ar])), lk.to_partial(-np.array([ma]))], 1), (2, 1))
    squares, logs = batch.squares_and_logs(np.arange(2), z)
    errors = batch.errors(z)
    for i, x in enumerate(xs):
        want = dense_likelihood(x, ar, ma)
        assert np.allclose([squares[i] * batch.spread[i] ** 2, logs[i]], want)
        assert (errors[i, : 40 - len(x)] == 0).all()
    value, slope = batch.value_and_slope(np.arange(2), z)
    for k in range(z.shape[1]):
        h = np.zeros_like(z)
        h[:, k] = 1e-6
        assert np.allclose(slope[:, k], (batch.loss(np.arange(2), z + h) - batch.loss(np.arange(2), z - h)) / 2e-6, atol=1e-7)
    assert np.allclose(lk.from_partial(lk.to_partial(np.array([ar or [0.1]]))), [ar or [0.1]])


def brute_trees(x, y, rounds, rate, depth, l2=1.0):
    """Boosting with a search over every split, one series."""
    pred, trees = np.full(len(y), y.mean()), []

    def grow(rows, g, level):
        total, n = g[rows].sum(), len(rows)
        before = total * total / (n + l2)
        best, cut = 1e-12 * (1 + before), None
        for f in range(x.shape[1]) if level < depth else ():
            values = np.unique(x[rows, f])
            for a, b in zip(values[:-1], values[1:]):
                left = x[rows, f] <= (a + b) / 2
                gl, nl = g[rows][left].sum(), left.sum()
                rise = gl * gl / (nl + l2) + (total - gl) ** 2 / (n - nl + l2) - before
                if rise > best + (1e-12 * (1 + before) if cut else 0):
                    best, cut = rise, (f, (a + b) / 2)
        if cut is None:
            return -rate * total / (n + l2)
        left = x[rows, cut[0]] <= cut[1]
        return *cut, grow(rows[left], g, level + 1), grow(rows[~left], g, level + 1)

    def leaf(node, row):
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    for _ in range(rounds):
        trees.append(grow(np.arange(len(y)), pred - y, 0))
        pred = pred + np.array([leaf(trees[-1], r) for r in x])
    return pred


def test_trees_of_many_series_equal_brute_force():
    rng = np.random.default_rng(0)
    sizes = [60, 33, 5, 80]
    series = np.repeat(np.arange(4), sizes)
    x = rng.normal(size=(sum(sizes), 4)).round(1)
    y = np.sin(2 * x[:, 0]) + x[:, 1] ** 2 + rng.normal(size=len(x)) * 0.1
    trees = fit_trees(series, x, y, 4, rounds=6, depth=3, rate=0.3)
    got = trees.predict(series, x)
    for s in range(4):
        assert np.allclose(got[series == s], brute_trees(x[series == s], y[series == s], 6, 0.3, 3))


def test_corrections_roll_the_trees_of_each_series(spark, panel):
    """The recursion in batches equals one-step predictions of each series alone; horizons differ."""
    params = arima.fit_arima(random_panel(panel), SPEC, (1, 1, 1)).persist()
    windows = residual.residual_windows(arima.residuals(params, SPEC), SPEC).persist()
    boosters, scalers = residual.fit_boosters(windows, SPEC, {"rounds": 5}).persist(), residual.lag_scalers(windows, SPEC)
    until = F.when(F.col("store_id") == "S0", 2).otherwise(3)
    got = {}
    for r in residual.corrections(boosters, params, scalers, SPEC, until).orderBy("step").collect():
        got.setdefault((r.store_id, r.sku_id), []).append(r.correction)
    state = params.join(scalers, KEYS).join(boosters, KEYS).toPandas()
    assert len(state) == 4
    for i, r in state.iterrows():
        trees, window, want = residual._stacked(state.iloc[i:i + 1]), np.array(r["resid"][-10:]), []
        for _ in range(2 if r.store_id == "S0" else 3):
            x = (window - r.lag_mean) / np.where(np.array(r.lag_std) > 0, r.lag_std, 1)
            want.append(trees.predict(np.zeros(1, int), x[None])[0])
            window = np.append(window[1:], want[-1])
        assert np.allclose(got[r.store_id, r.sku_id], want)
    fitted = residual.corrected(windows, boosters, SPEC)
    sse = fitted.agg(F.sum(F.pow("resid", F.lit(2))), F.sum(F.pow(F.col("resid") - F.col("correction"), F.lit(2)))).first()
    assert fitted.count() == windows.count() and sse[1] < sse[0]


def test_batches_hold_whole_series():
    frames = [pd.DataFrame({"k": list(p), "v": range(len(p))}) for p in ("aab", "bbb", "", "bc", "dd")]
    batches = list(whole_series(frames, ["k"], rows=3))
    assert ["".join(b.k) for b in batches] == ["aa", "bbbbb", "c", "dd"]
    missing = pd.DataFrame({"k": ["a", None, None, "b"], "j": [1, 1, 1, 1]})
    assert list(series_starts(missing, ["k", "j"])) == [0, 1, 3]


def test_fit_rejects_bad_series():
    with pytest.raises(ValueError, match="too short"):
        arima.fit_with_fallback(np.array([1.0, 2.0]), (1, 1, 1))
    with pytest.raises(ValueError, match="missing or infinite"):
        arima.fit_with_fallback(np.array([1.0, np.nan, 2.0, 3.0]), (1, 1, 1))
    order, _ = arima.fit_with_fallback(np.array([1.0, 2.0, 4.0]), (3, 1, 2))
    assert order in arima.FALLBACK_ORDERS


@pytest.mark.parametrize("order", [(0, 1, 0), (1, 0, 0), (2, 1, 1), (0, 2, 1), (1, 1, 2)])
def test_fold_equals_plain_recursion(panel, order):
    rng = np.random.default_rng(5)
    y = 20 + rng.normal(size=80).cumsum()
    params = arima.fit_arima(panel({("A", "x"): y}), SPEC, order)
    got = [r.yhat for r in arima.arima_forecast(params, SPEC, 6).orderBy("step").collect()]
    fit = arima.fit_exact([y], order)[0]
    w, e, path = list(fit["w"]), list(fit["resid"]), []
    for _ in range(6):
        nxt = sum(a * w[-1 - i] for i, a in enumerate(fit["ar"])) + sum(b * e[-1 - j] for j, b in enumerate(fit["ma"]))
        w.append(nxt)
        e.append(0.0)
        path.append(nxt + fit["const"])
    level, slope = y[-1], y[-1] - y[-2]
    want = []
    for x in path:
        slope = slope + x if order[1] == 2 else x
        level = x if order[1] == 0 else level + slope
        want.append(level)
    assert np.allclose(got, want)


def test_constant_series_fits(panel):
    params = arima.fit_arima(panel({("A", "x"): [12.0] * 50}), SPEC)
    got = [r.yhat for r in arima.arima_forecast(params, SPEC, 5).collect()]
    assert np.allclose(got, [12.0] * 5)


def test_status_per_series(panel):
    df = panel({("A", "x"): np.arange(30) % 7, ("B", "x"): range(10), ("C", "x"): [*range(29), None]})
    out = {r.store_id: (r.status, r.reason) for r in arima.fit_arima(df, SPEC, min_rows=20).collect()}
    assert out["A"] == ("fitted", None)
    assert out["B"] == ("skipped", "10 periods, needs 20")
    assert out["C"][0] == "failed" and "missing or infinite" in out["C"][1]


def test_nothing_fitted_is_an_error(panel):
    with pytest.raises(RuntimeError, match="all 1 series"):
        hybrid.fit_hybrid(panel({("A", "x"): range(5)}), SPEC)


@pytest.mark.parametrize("fitted, want", [(12, [8, 9, 10, 11, 12]), (15, [5, 6, 7, 8, 9])])
def test_gap_alignment(spark, panel, fitted, want):
    """A ramp 0, 1, 2, … taken past the rows held back from the fit."""
    needs = al.forecast_gap(panel({("A", "x"): range(20)}), panel({("A", "x"): range(fitted)}), SPEC).withColumn("n_test", F.lit(5))
    ramp = spark.range(1, 40).select(F.lit("A").alias("store_id"), F.lit("x").alias("sku_id"), F.col("id").cast("int").alias("step"), (F.col("id") - 1.0).alias("yhat"))
    out = al.past_the_gap(ramp, needs, SPEC).orderBy("step").collect()
    assert [r.yhat for r in out] == want and [r.step for r in out] == [1, 2, 3, 4, 5]


def test_fallback_choice(spark):
    pair = spark.createDataFrame([(1, 2.0, 4.0), (2, None, 4.0), (3, 2.0, None), (4, None, None)], "step int, sequence double, hybrid double")
    def chosen(name):
        return [r.yhat for r in al.select_predictions(pair, name).orderBy("step").collect()]

    assert chosen("Ensemble") == [3.0, 4.0, 2.0, None]
    assert chosen("Sequence") == [2.0, 4.0, 2.0, None]
    assert chosen("Hybrid") == [4.0, 4.0, 2.0, None]


def test_best_model(spark):
    rows = [("a", float(y), y + 0.1) for y in (1, 2, 3, 4)] + [("b", float(y), y + 1.0) for y in (1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "model string, y double, yhat double")
    best = ev.best_model(ev.error_metrics(df)).first()
    assert (best.best_model, best.improvement_pct) == ("a", 90.0)
    assert ev.choose_model(ev.error_metrics(df)) == "a"
    assert ev.choose_model(ev.error_metrics(df.limit(0))) == "Ensemble"
    assert [r.model for r in ev.compare_models(ev.error_metrics(df), "MAPE").collect()] == ["a", "b"]
    with pytest.raises(ValueError, match="no models"):
        ev.require_models(ev.error_metrics(df.limit(0)))
    with pytest.raises(ValueError, match="length mismatch"):
        ev.require_complete(df.where("not (model = 'a' and y = 1)"), [])


@pytest.mark.parametrize("kind", ["gbt", "linear"])
def test_recursion_equals_model(panel, kind):
    """The fold over stored parameters predicts what the fitted model predicts."""
    windows = splits.split_windows(random_panel(panel), SPEC, 10, splits.sequence_rule(10)).persist()
    model = pooled.fit_sequence_model(windows, 10, kind, max_iter=5).model
    state = windows.where("pos = n_rows - 1").select(*KEYS, "window")
    rolled = roll_forward(model, state, 3).collect()
    rows = state
    paths = {}
    for _ in range(3):
        scored = model.transform(rows.withColumn("features", array_to_vector("window"))).persist()
        for r in scored.collect():
            paths.setdefault((r.store_id, r.sku_id), []).append(r.prediction)
        rows = scored.select(*KEYS, F.concat(F.slice("window", 2, 9), F.array("prediction")).alias("window"))
    for r in rolled:
        assert np.allclose(r.path, paths[r.store_id, r.sku_id])


def test_train_forecast_submit(spark, panel):
    df = random_panel(panel)
    cut = dt.date(2024, 1, 1) + dt.timedelta(days=96)
    history = df.where(F.col("date") < F.lit(cut))
    test = df.where(F.col("date") >= F.lit(cut)).drop("units_sold").withColumn("record_ID", F.concat_ws("_", *KEYS, F.col("date").cast("string")))
    trained = train_and_backtest(history, SPEC, 10, kind="linear", booster={"rounds": 3})
    sizes = {r.model: r.n_samples for r in trained.metrics.collect()}
    assert set(sizes) == {"Sequence", "Hybrid", "Ensemble"} and len(set(sizes.values())) == 1
    ahead = future_forecast(trained, history, SPEC, 7)
    assert ahead.count() == 4 * 3 * 7
    assert ahead.agg(F.min("date"), F.max("date")).first() == (cut, cut + dt.timedelta(days=6))
    out = generate_submission(trained, history, test, SPEC)
    assert out.count() == test.count() == out.select("record_ID").distinct().count()
    assert out.where("units_sold < 0 or units_sold is null").isEmpty()
    stranger = test.limit(1).withColumn("store_id", F.lit("S9"))
    with pytest.raises(ValueError, match="S9"):
        generate_submission(trained, history, test.unionByName(stranger), SPEC)


def test_best_round_waits_for_patience():
    assert pooled.best_round([3.0, 2.0, 1.0]) == (3, 3)
    assert pooled.best_round([3.0, 1.0, 2.0, 0.5, 2.0], patience=2) == (4, 5)
    assert pooled.best_round([3.0, 1.0, 2.0, 2.0, 0.5], patience=2) == (2, 4)


def test_trees_are_kept_where_a_signal_exists(spark):
    """A panel of two seasons keeps more than one tree, and the kept rounds end at the lowest validation loss."""
    days = spark.range(3 * 200).select(
        F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("store_id"), F.lit("k").alias("sku_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 3).cast("int")).alias("date"),
        (20 + 6 * F.sin(F.floor(F.col("id") / 3) * 0.9) + 5 * F.sin(F.floor(F.col("id") / 3) * 0.37)).alias("units_sold"))
    windows = splits.split_windows(days, SPEC, 14, splits.sequence_rule(14))
    trained = pooled.fit_sequence_model(windows, 14)
    best = min(trained.val_losses)
    assert len(trained.model.trees) == trained.val_losses.index(best) + 1 > 1


def test_fit_says_whether_it_converged():
    y = np.cumsum(np.random.default_rng(3).normal(size=200))
    assert arima.fit_css(y, (1, 1, 1))["converged"]
    assert not arima.fit_css(y, (1, 1, 1), iterations=0)["converged"]
