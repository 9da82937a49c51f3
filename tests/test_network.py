"""The recurrent network: gradient, learning, recursion, storage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.forecast import network as nw
from panelcast.forecast import pooled
from panelcast.operators import splits
from panelcast.spec import SeriesSpec

SPEC = SeriesSpec()


@pytest.mark.parametrize("units", [1, 5])
def test_gradient_equals_finite_differences(units):
    rng = np.random.default_rng(0)
    flat = nw.initial_weights(units, 1, np.float64)
    flat = flat + rng.normal(size=len(flat)) * 0.1
    x, y = rng.normal(size=(6, 8)), rng.normal(size=6)
    for drop in (False, True):  # the same masks each time
        loss, grad = nw.loss_and_gradient(flat, units, x, y, np.random.default_rng(3) if drop else None)
        for i in range(len(flat)):
            step = np.zeros_like(flat)
            step[i] = 1e-6
            up, down = (nw.loss_and_gradient(flat + s, units, x, y, np.random.default_rng(3) if drop else None)[0] for s in (step, -step))
            assert abs((up - down) / 2e-6 - grad[i]) < 1e-7
        assert np.isfinite(loss)


def test_predict_is_the_forward_pass_of_the_loss():
    rng = np.random.default_rng(1)
    flat = nw.initial_weights(4, 2, np.float64)
    x, y = rng.normal(size=(9, 7)), rng.normal(size=9)
    got = nw.SequenceNetwork(flat, 7, 4).predict(x)
    assert np.isclose(np.mean((got - y) ** 2), nw.loss_and_gradient(flat, 4, x, y)[0])


@pytest.fixture(scope="module")
def seasonal(spark):
    """Two series of two seasons each, without noise."""
    days = spark.range(2 * 160).select(
        F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("store_id"), F.lit("k").alias("sku_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 2).cast("int")).alias("date"),
        (20 + 6 * F.sin(F.floor(F.col("id") / 2) * 0.9) + 4 * F.sin(F.floor(F.col("id") / 2) * 0.37)).alias("units_sold"))
    return splits.split_windows(days, SPEC, 10, splits.sequence_rule(10)).persist()


def test_learns_keeps_the_best_and_rolls(spark, seasonal, tmp_path):
    trained = pooled.fit_sequence_model(seasonal, 10, kind="network", max_iter=25, units=16, batch_size=8, tasks=2)
    assert len(trained.losses) == len(trained.val_losses) <= 25 and trained.losses[-1] < trained.losses[0]
    tested = seasonal.where("is_test")
    scored = pooled.predict_windows(trained, tested, SPEC)
    network, naive = (r.e for r in (
        scored.agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("e")).first(),
        seasonal.where("is_test").join(scored, [*SPEC.keys, "date"]).selectExpr(
            "avg(abs(target - element_at(window, -1)) / nullif(target, 0) * y) AS e").first()))
    assert scored.count() == tested.count() and network < naive
    # The kept weights are those of the lowest validation loss.
    held = pooled.training_windows(seasonal, 10).where("is_validation").toPandas()
    x = np.stack(held["window"].to_numpy()).astype(np.float32)
    assert np.isclose(np.mean((trained.model.predict(x) - held["target"]) ** 2), min(trained.val_losses), rtol=1e-4)
    # Recursion: one-step predictions fed back; horizons of each series.
    state = seasonal.where("pos = n_rows - 1").select("store_id", "window")
    rolled = trained.model.rolled(state, F.when(F.col("store_id") == "s0", 3).otherwise(0)).collect()
    for r in rolled:
        window, want = np.array(r.window, np.float32), []
        for _ in range(3 if r.store_id == "s0" else 0):
            want.append(trained.model.predict(window[None])[0])
            window = np.append(window[1:], np.float32(want[-1]))
        assert np.allclose(r.path, want, atol=1e-5)
    trained.model.save(spark, str(tmp_path / "net"))
    again = nw.SequenceNetwork.load(spark, str(tmp_path / "net"))
    assert np.array_equal(again.predict(x), trained.model.predict(x))


def test_one_task_equals_plain_training(seasonal):
    """Averaging over one task leaves plain mini-batch Adam."""
    rows = pooled.training_windows(seasonal, 10).where("not is_validation").limit(20)
    network, losses, val_losses, _ = nw.fit_network(rows, 10, units=3, epochs=1, batch_size=64, tasks=1)
    data = rows.toPandas()
    x, y = np.stack(data["window"].to_numpy()).astype(np.float32), data["target"].to_numpy(np.float32)
    flat = nw.initial_weights(3)
    rng = np.random.default_rng([42, 0])
    order = rng.permutation(len(x))
    loss, grad = nw.loss_and_gradient(flat, 3, x[order], y[order], rng)
    want = flat - nw.RATE * grad / (np.abs(grad) + nw.EPSILON)  # the first step has the size of the rate
    assert not val_losses and np.isclose(losses[0], loss, rtol=0.2)  # masks follow the order of the rows
    assert np.abs(network.weights - want).max() <= 2.1 * nw.RATE


def test_windows_must_fit(spark, seasonal):
    network = nw.SequenceNetwork(nw.initial_weights(2), 11, 2)
    with pytest.raises(Exception, match="must hold 11 values"):
        network.scored(seasonal).count()
    with pytest.raises(ValueError, match="no complete"):
        nw.fit_network(pooled.training_windows(seasonal, 10).limit(0), 10, units=2, epochs=1)
