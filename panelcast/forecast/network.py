"""A recurrent network over the scaled lag windows of all series: two LSTM layers and two dense ones.

Layers: LSTM(units), dropout, LSTM(units / 2), dropout, dense(16, rectified), dense(1); mean squared error; Adam. Windows are
dealt to tasks once and stored. An epoch is one Spark job: every task starts from the same weights, goes through its windows in
mini-batches with back-propagation through time, and returns its weights and Adam moments; these are averaged by the number of
windows, summed in groups of ``FAN_IN`` tasks until few are left, so that the driver sees a handful of vectors of one model's
size. With one task this is plain mini-batch training. The tasks also score the incoming weights on the validation windows, so
that early stopping needs no job of its own. A lost task only repeats its part of an epoch.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.session import written

# Layer sizes' ratio, dropout, learning rate, patience.
DENSE, DROPOUT, RATE, PATIENCE = 16, 0.2, 0.001, 8
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-7
FAN_IN, ROWS_AT_ONCE = 32, 4096


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def shapes(units: int) -> dict[str, tuple[int, ...]]:
    """Names and shapes of the weights, in the order of the flat vector. Gates lie side by side: in, forget, cell, out."""
    half = max(1, units // 2)
    return {
        "w1": (1, 4 * units), "u1": (units, 4 * units), "b1": (4 * units,),
        "w2": (units, 4 * half), "u2": (half, 4 * half), "b2": (4 * half,),
        "w3": (half, DENSE), "b3": (DENSE,), "w4": (DENSE, 1), "b4": (1,),
    }


def split_weights(flat: np.ndarray, units: int) -> dict[str, np.ndarray]:
    """Views of the flat vector."""
    out, at = {}, 0
    for name, shape in shapes(units).items():
        size = int(np.prod(shape))
        out[name] = flat[at:at + size].reshape(shape)
        at += size
    return out


def initial_weights(units: int, seed: int = 42, kind: type = np.float32) -> np.ndarray:
    """Uniform input weights scaled by fan-in and fan-out, orthogonal recurrent ones, forget gates open."""
    rng = np.random.default_rng(seed)
    parts = []
    for name, shape in shapes(units).items():
        if name in ("u1", "u2"):
            q = np.linalg.qr(rng.normal(size=(shape[1], shape[0])))[0].T
            parts.append(q.ravel())
        elif name.startswith("b"):
            bias = np.zeros(shape)
            if name in ("b1", "b2"):
                bias[shape[0] // 4:shape[0] // 2] = 1.0
            parts.append(bias)
        else:
            reach = np.sqrt(6.0 / sum(shape))
            parts.append(rng.uniform(-reach, reach, shape).ravel())
    return np.concatenate(parts).astype(kind)


def _lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray):
    """Outputs (time, batch, units) of one layer, and what the way back needs."""
    steps, batch, n = x.shape[0], x.shape[1], u.shape[0]
    drive = x @ w + b
    h, c = np.zeros((steps + 1, batch, n), x.dtype), np.zeros((steps + 1, batch, n), x.dtype)
    gates = np.empty((steps, batch, 4 * n), x.dtype)
    for t in range(steps):
        z = drive[t] + h[t] @ u
        g = gates[t]
        g[:] = _sigmoid(z)
        g[:, 2 * n:3 * n] = np.tanh(z[:, 2 * n:3 * n])
        c[t + 1] = g[:, n:2 * n] * c[t] + g[:, :n] * g[:, 2 * n:3 * n]
        h[t + 1] = g[:, 3 * n:] * np.tanh(c[t + 1])
    return h, c, gates


def _lstm_back(dh_out: np.ndarray, x: np.ndarray, w: np.ndarray, u: np.ndarray, state):
    """Gradients of one layer: (input, w, u, b)."""
    h, c, gates = state
    steps, batch, n = x.shape[0], x.shape[1], u.shape[0]
    dz = np.empty_like(gates)
    dh, dc = np.zeros((batch, n), x.dtype), np.zeros((batch, n), x.dtype)
    for t in range(steps - 1, -1, -1):
        i, f, a, o = (gates[t][:, k * n:(k + 1) * n] for k in range(4))
        dh = dh + dh_out[t]
        bent = np.tanh(c[t + 1])
        dc = dc + dh * o * (1 - bent * bent)
        d = dz[t]
        d[:, :n], d[:, n:2 * n] = dc * a * i * (1 - i), dc * c[t] * f * (1 - f)
        d[:, 2 * n:3 * n], d[:, 3 * n:] = dc * i * (1 - a * a), dh * bent * o * (1 - o)
        dc = dc * f
        dh = d @ u.T
    flat = dz.reshape(-1, 4 * n)
    return dz @ w.T, x.reshape(-1, x.shape[2]).T @ flat, h[:-1].reshape(-1, n).T @ flat, flat.sum(0)


def loss_and_gradient(flat: np.ndarray, units: int, x: np.ndarray, y: np.ndarray, rng=None) -> tuple[float, np.ndarray]:
    """Mean squared error of a batch (rows, lags) and its gradient; dropout only with ``rng``."""
    p = split_weights(flat, units)
    rows = len(x)
    x0 = np.ascontiguousarray(x.T[:, :, None])
    first = _lstm(x0, p["w1"], p["u1"], p["b1"])
    half = p["u2"].shape[0]
    drop1 = drop2 = None
    x1 = first[0][1:]
    if rng is not None:
        drop1 = ((rng.random(x1.shape) >= DROPOUT) / (1 - DROPOUT)).astype(flat.dtype)
        drop2 = ((rng.random((rows, half)) >= DROPOUT) / (1 - DROPOUT)).astype(flat.dtype)
        x1 = x1 * drop1
    second = _lstm(x1, p["w2"], p["u2"], p["b2"])
    x2 = second[0][-1] if drop2 is None else second[0][-1] * drop2
    z3 = x2 @ p["w3"] + p["b3"]
    x3 = np.maximum(z3, 0)
    error = (x3 @ p["w4"] + p["b4"])[:, 0] - y
    grad = np.empty_like(flat)
    g = split_weights(grad, units)
    d4 = (2.0 / rows * error)[:, None].astype(flat.dtype)
    g["w4"][:], g["b4"][:] = x3.T @ d4, d4.sum(0)
    d3 = (d4 @ p["w4"].T) * (z3 > 0)
    g["w3"][:], g["b3"][:] = x2.T @ d3, d3.sum(0)
    last = d3 @ p["w3"].T
    if drop2 is not None:
        last = last * drop2
    out2 = np.zeros_like(second[0][1:])
    out2[-1] = last
    dx1, g["w2"][:], g["u2"][:], g["b2"][:] = _lstm_back(out2, x1, p["w2"], p["u2"], second)
    if drop1 is not None:
        dx1 = dx1 * drop1
    _, g["w1"][:], g["u1"][:], g["b1"][:] = _lstm_back(dx1, x0, p["w1"], p["u1"], first)
    return float(np.mean(error * error)), grad


@dataclass
class SequenceNetwork:
    """Fitted weights; small enough to travel with every task."""

    weights: np.ndarray
    seq: int
    units: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        p = split_weights(self.weights, self.units)
        out = []
        for at in range(0, len(x), ROWS_AT_ONCE):
            part = np.ascontiguousarray(x[at:at + ROWS_AT_ONCE].T[:, :, None]).astype(self.weights.dtype)
            h = _lstm(_lstm(part, p["w1"], p["u1"], p["b1"])[0][1:], p["w2"], p["u2"], p["b2"])[0][-1]
            out.append((np.maximum(h @ p["w3"] + p["b3"], 0) @ p["w4"] + p["b4"])[:, 0])
        return np.concatenate(out).astype(float) if out else np.zeros(0)

    def scored(self, windows: DataFrame) -> DataFrame:
        """``windows`` with ``prediction``; a window with a missing value gives a missing prediction."""
        schema = T.StructType([*windows.schema.fields, T.StructField("prediction", T.DoubleType())])

        def run(frames):
            for frame in frames:
                yield frame.assign(prediction=self.predict(_matrix(frame["window"], self.seq)))

        return windows.mapInPandas(run, schema)

    def rolled(self, state: DataFrame, steps: int | Column) -> DataFrame:
        """``state`` with ``path``: one prediction a step, each fed back; all series of a batch step together."""
        until = F.lit(steps) if isinstance(steps, int) else steps
        ready = state.withColumn("_steps", F.greatest(until.cast("int"), F.lit(0)))
        schema = T.StructType([*ready.schema.fields, T.StructField("path", T.ArrayType(T.DoubleType()))])

        def run(frames):
            for frame in frames:
                window, until_ = _matrix(frame["window"], self.seq), frame["_steps"].to_numpy()
                path = np.empty((len(frame), int(until_.max(initial=0))))
                for k in range(path.shape[1]):
                    path[:, k] = self.predict(window)
                    window = np.concatenate([window[:, 1:], path[:, k:k + 1]], 1)
                yield frame.assign(path=[p[:n].tolist() for p, n in zip(path, until_)])

        return ready.mapInPandas(run, schema).drop("_steps")

    def save(self, spark: SparkSession, path: str) -> None:
        row = [(self.seq, self.units, bytes(self.weights.astype("<f4").tobytes()))]
        spark.createDataFrame(row, "seq int, units int, weights binary").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> SequenceNetwork:
        row = spark.read.parquet(path).first()
        return SequenceNetwork(np.frombuffer(row["weights"], "<f4").astype(np.float32), row["seq"], row["units"])


def _matrix(windows: pd.Series, seq: int) -> np.ndarray:
    if not len(windows):
        return np.zeros((0, seq), np.float32)
    out = np.stack([np.asarray(w, np.float32) for w in windows])
    if out.shape[1] != seq:
        raise ValueError(f"windows must hold {seq} values, got {out.shape[1]}")
    return out


# --- training ------------------------------------------------------------------------------------------------------

_PARTS = "part int, n long, loss double, val_n long, val_loss double, state binary"


def _epoch(weights, moment, spread, units, seq, batch_size, seed, steps_done):
    """One task's share of an epoch; ``state`` holds (weights, first moment, second moment) times its windows."""
    def run(frames):
        x, y, held = [], [], []
        for f in frames:
            x.append(_matrix(f["window"], seq))
            y.append(f["target"].to_numpy(np.float32))
            held.append(f["is_validation"].to_numpy(bool))
        if not x:
            return
        x, y, held = np.concatenate(x), np.concatenate(y), np.concatenate(held)
        part = TaskContext.get().partitionId()
        error = SequenceNetwork(weights, seq, units).predict(x[held]) - y[held]
        x, y = x[~held], y[~held]
        rng = np.random.default_rng([seed, part])
        order = rng.permutation(len(x))
        w, m, v, k, loss = weights.copy(), moment.copy(), spread.copy(), steps_done, 0.0
        for at in range(0, len(x), batch_size):
            rows = order[at:at + batch_size]
            value, grad = loss_and_gradient(w, units, x[rows], y[rows], rng)
            loss += value * len(rows)
            k += 1
            m = BETA1 * m + (1 - BETA1) * grad
            v = BETA2 * v + (1 - BETA2) * grad * grad
            w = w - RATE * (m / (1 - BETA1**k)) / (np.sqrt(v / (1 - BETA2**k)) + EPSILON)
        state = (np.concatenate([w, m, v]).astype(np.float64) * len(x)).tobytes()
        yield pd.DataFrame({"part": [part], "n": [len(x)], "loss": [loss], "val_n": [int(held.sum())],
                            "val_loss": [float((error * error).sum())], "state": [state]})
    return run


def _summed(key, rows: pd.DataFrame) -> pd.DataFrame:
    state = sum(np.frombuffer(s, np.float64) for s in rows["state"])
    return pd.DataFrame({"part": [int(key[0])], "n": [rows["n"].sum()], "loss": [rows["loss"].sum()], "val_n": [rows["val_n"].sum()],
                         "val_loss": [rows["val_loss"].sum()], "state": [state.tobytes()]})


def fit_network(
    rows: DataFrame, seq: int, units: int = 64, epochs: int = 50, batch_size: int = 32, seed: int = 42, tasks: int | None = None,
) -> tuple[SequenceNetwork, list[float], list[float], float]:
    """(network, training losses, validation losses, seconds) from rows (window, target, is_validation).

    Training stops when the validation loss (without validation rows, the training loss) has not fallen for ``PATIENCE``
    epochs; the best weights are kept. Rows with a missing value take no part.
    """
    spark, started = rows.sparkSession, time.perf_counter()
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = rows.where(F.col("target").isNotNull() & F.forall("window", lambda v: v.isNotNull())).select(
        F.col("window").cast("array<float>").alias("window"), F.col("target").cast("float").alias("target"), "is_validation")
    dealt = written(whole, "network_windows").repartition(tasks).persist()
    weights = initial_weights(units, seed)
    moment, spread = np.zeros_like(weights), np.zeros_like(weights)
    losses: list[float] = []
    val_losses: list[float] = []
    best, best_weights, stale, steps = np.inf, weights, 0, 0
    for epoch in range(epochs + 1):  # one more, to judge the last weights
        parts = dealt.mapInPandas(_epoch(weights, moment, spread, units, seq, batch_size, seed + epoch, steps), _PARTS)
        for _ in range(int(np.ceil(np.log(max(tasks, 2)) / np.log(FAN_IN)))):
            parts = parts.groupBy(F.expr(f"part div {FAN_IN}").cast("int").alias("part")).applyInPandas(_summed, _PARTS)
        found = parts.collect()
        n = sum(r["n"] for r in found)
        if not n:
            raise ValueError("no complete training windows")
        val_n = sum(r["val_n"] for r in found)
        # The validation loss belongs to the weights that this epoch started from, the training loss to the epoch itself.
        judged = sum(r["val_loss"] for r in found) / val_n if val_n else (losses[-1] if losses else np.inf)
        if epoch:
            if val_n:
                val_losses.append(judged)
            if judged < best:
                best, best_weights, stale = judged, weights, 0
            else:
                stale += 1
            if stale >= PATIENCE or epoch == epochs:
                break
        state = sum(np.frombuffer(r["state"], np.float64) for r in found) / n
        weights, moment, spread = (a.astype(np.float32) for a in np.split(state, 3))
        losses.append(sum(r["loss"] for r in found) / n)
        steps += max(1, -(-n // (tasks * batch_size)))
    dealt.unpersist()
    return SequenceNetwork(best_weights, seq, units), losses[: len(val_losses) or None], val_losses, time.perf_counter() - started
