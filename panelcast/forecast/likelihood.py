"""Exact Gaussian likelihood of ARMA(p, q) for a batch of series at once.

With the shocks before the sample known, the errors follow a plain recursion; they depend linearly on the state before the
sample, through the impulse response of the moving-average part. Integrating that state out gives the exact likelihood from two
recursions over time, whatever the parameters: the errors from a zero state, and the impulse response. One loop over time
serves all series of a batch. One-step errors of the fitted models come from a Kalman filter, whose loop also holds every
series; once the one-step variance has settled it goes on with the plain recursion.

Series end at the same step (shorter ones start later). Derivatives are exact: the recursions run for each parameter with that
parameter moved by a tiny imaginary step, and the imaginary part of the result is the derivative. The search is a quasi-Newton
one (BFGS) with halved steps. Autoregressive and moving-average polynomials stay stationary and invertible, as they are built
from partial correlations between -1 and 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_TINY = 1e-30
SETTLED = 1e-11  # relative change of the one-step variance


def from_partial(raw: np.ndarray) -> np.ndarray:
    """Coefficients of stable polynomials from unbounded numbers, one row a series (Durbin-Levinson on tanh)."""
    r = np.tanh(raw)
    k = r.shape[1]
    c = np.zeros_like(r)
    for i in range(k):
        before = c[:, :i].copy()
        c[:, i] = r[:, i]
        c[:, :i] = before - r[:, i:i + 1] * before[:, ::-1]
    return c


def to_partial(coefficients: np.ndarray) -> np.ndarray:
    """Inverse of ``from_partial``; coefficients at or beyond the border are moved inside."""
    c, k = coefficients.astype(float).copy(), coefficients.shape[1]
    r = np.zeros_like(c)
    for i in range(k - 1, -1, -1):
        r[:, i] = np.clip(c[:, i], -0.97, 0.97)
        if i:
            before = c[:, :i].copy()
            c[:, :i] = (before + r[:, i:i + 1] * before[:, ::-1]) / (1 - r[:, i:i + 1] ** 2)
    return np.arctanh(r)


def stationary(ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stationary variance of the state, with and without the newest shock."""
    n, p, q = len(ar), ar.shape[1], ma.shape[1]
    r = max(p, q + 1)
    kind = np.result_type(ar, ma, float)
    load, move = np.zeros((n, r), kind), np.zeros((n, r, r), kind)
    load[:, 0], load[:, 1:q + 1] = 1.0, ma
    move[:, :p, 0] = ar
    move[:, np.arange(r - 1), np.arange(1, r)] = 1.0
    noise = load[:, :, None] * load[:, None, :]
    double = np.einsum("nij,nkl->nikjl", move, move).reshape(n, r * r, r * r)  # P = T P T' + R R'
    whole = np.linalg.solve(np.eye(r * r) - double, noise.reshape(n, r * r, 1)).reshape(n, r, r)
    return whole, whole - noise


def kalman(x: np.ndarray, start: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """One-step errors of mean-zero series ``x`` (series, time), each from its ``start`` on; zero before."""
    n, length = x.shape
    p, q = ar.shape[1], ma.shape[1]
    first = stationary(ar, ma)[0]
    r = first.shape[1]
    phi, load = np.zeros((n, r)), np.zeros((n, r))
    phi[:, :p], load[:, 0], load[:, 1:q + 1] = ar, 1.0, ma
    noise = load[:, :, None] * load[:, None, :]
    state, spread, errors = np.zeros((n, r)), first.copy(), np.zeros((n, length))
    latest, settled = int(start.max(initial=0)), False

    def moved(s):
        """T s for a state, or a row of states."""
        out = phi.reshape(n, r, *[1] * (s.ndim - 2)) * s[:, :1]
        out[:, :-1] += s[:, 1:]
        return out

    for t in range(int(start.min(initial=0)), length):
        if t <= latest:
            fresh = t == start
            state[fresh], spread[fresh] = 0.0, first[fresh]
        v = np.where(t >= start, x[:, t] - state[:, 0], 0.0)
        errors[:, t] = v
        if settled:
            state = moved(state + load * v[:, None])
            continue
        gain = spread[:, :, 0] / spread[:, :1, 0]
        state = moved(state + gain * v[:, None])
        known = spread - gain[:, :, None] * spread[:, None, 0, :]
        spread = moved(moved(known).transpose(0, 2, 1)).transpose(0, 2, 1) + noise
        settled = t > latest and not t % 8 and bool((np.abs(spread[:, 0, 0] - 1.0) < SETTLED).all())
    return errors


@dataclass
class Fit:
    """Result for one series, in its own scale; ``resid`` are the one-step errors."""

    const: float
    ar: np.ndarray
    ma: np.ndarray
    sigma2: float
    log_lik: float
    resid: np.ndarray
    converged: bool


class _Batch:
    """Standardised series of one batch, lined up at their ends, and the objective over unbounded parameters."""

    def __init__(self, series: list[np.ndarray], p: int, q: int, with_mean: bool):
        self.p, self.q, self.k = p, q, p + q + with_mean
        self.with_mean = with_mean
        self.size = np.array([len(s) for s in series])
        length = int(self.size.max())
        self.start = length - self.size
        self.center = np.array([s.mean() if with_mean else 0.0 for s in series])
        spread = np.array([np.sqrt(np.mean((s - c) ** 2)) for s, c in zip(series, self.center)])
        flat = spread <= 1e-9 * np.maximum(1.0, np.abs(self.center))
        self.spread = np.where(flat, 1.0, spread)
        self.x = np.zeros((length, len(series)))  # by time, so that a step of the recursion is one row
        for row, (s, c, d, f) in enumerate(zip(series, self.center, self.spread, flat)):
            self.x[length - len(s):, row] = 0.0 if f else (s - c) / d
        self.inside = (np.arange(length)[:, None] >= self.start).astype(float)

    def parts(self, z):
        ar, ma = from_partial(z[:, : self.p]), -from_partial(z[:, self.p:self.p + self.q])
        return ar, ma, z[:, -1] if self.with_mean else np.zeros(len(z))

    def loss(self, rows: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Half of -2 log L / n with the variance concentrated out, up to a constant; ``z`` may be complex."""
        squares, logs = self.squares_and_logs(rows, z)
        return 0.5 * (np.log(squares / self.size[rows] + 1e-12) + logs / self.size[rows])

    def squares_and_logs(self, rows, z):
        ar, ma, mean = self.parts(z)
        n, r = len(rows), max(self.p, self.q + 1)
        x = (self.x[:, rows] - mean * self.inside[:, rows]).astype(z.dtype)
        errors = x.copy()
        for i in range(1, self.p + 1):
            errors[i:] -= ar[:, i - 1] * x[:-i]
        impulse = np.zeros_like(errors)
        impulse[self.start[rows], np.arange(n)] = 1.0
        if self.q:
            both, theta = np.concatenate([errors, impulse], 1), np.tile(ma, (2, 1)).T.copy()
            for t in range(1, len(both)):
                for j in range(1, min(self.q, t) + 1):
                    both[t] -= theta[j - 1] * both[t - j]
            errors, impulse = both[:, :n], both[:, n:]
        shifted = [impulse, *(np.concatenate([np.zeros((i, n), impulse.dtype), impulse[:-i]]) for i in range(1, r))][:r]
        cross = np.stack([(s * errors).sum(0) for s in shifted], 1)
        inner = np.stack([np.stack([(s * o).sum(0) for o in shifted], 1) for s in shifted], 1)
        before = stationary(ar, ma)[1]
        spread = before @ inner
        spread[:, np.arange(r), np.arange(r)] += 1.0
        drawn = np.linalg.solve(spread, before @ cross[:, :, None])[:, :, 0]
        return (errors * errors).sum(0) - (cross * drawn).sum(1), np.log(np.linalg.det(spread))

    def errors(self, z: np.ndarray) -> np.ndarray:
        """One-step errors of all series (series, time)."""
        ar, ma, mean = self.parts(z)
        return kalman((self.x - mean * self.inside).T, self.start, ar, ma)

    def value_and_slope(self, rows: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.k:
            return self.loss(rows, z), np.zeros((len(rows), 0))
        many = np.repeat(rows, self.k)
        moved = np.repeat(z, self.k, 0).astype(complex)
        moved[np.arange(len(many)), np.tile(np.arange(self.k), len(rows))] += 1j * _TINY
        loss = self.loss(many, moved).reshape(len(rows), self.k)
        return loss[:, 0].real, loss.imag / _TINY


def _minimise(batch: _Batch, z: np.ndarray, iterations: int = 80, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Quasi-Newton steps for all series; (parameters, converged)."""
    n, k = z.shape
    every = np.arange(n)
    value, slope = batch.value_and_slope(every, z)
    bend = np.tile(np.eye(k), (n, 1, 1))
    done = (np.abs(slope).max(1) < tolerance) if k else np.ones(n, bool)
    flat = np.zeros(n, np.int64)  # steps in a row that hardly fell: towards the border, or at the limits of the arithmetic
    for _ in range(iterations):
        rows = np.flatnonzero(~done)
        if not len(rows):
            break
        move = -np.einsum("nij,nj->ni", bend[rows], slope[rows])
        fall = (move * slope[rows]).sum(1)
        wrong = fall >= 0
        if wrong.any():
            bend[rows[wrong]] = np.eye(k)
            move[wrong] = -slope[rows[wrong]]
            fall[wrong] = -(slope[rows[wrong]] ** 2).sum(1)
        size = np.abs(move).max(1)
        step = np.minimum(1.0, 1.0 / np.maximum(size, 1e-300))  # at most 1 in any parameter
        open_ = np.arange(len(rows))
        for _ in range(30):
            at = rows[open_]
            trial = z[at] + step[open_, None] * move[open_]
            v, g = batch.value_and_slope(at, trial)
            good = np.isfinite(v) & (v <= value[at] + 1e-4 * step[open_] * fall[open_])
            for row, z_new, v_new, g_new in zip(at[good], trial[good], v[good], g[good]):
                s, y = z_new - z[row], g_new - slope[row]
                sy = s @ y
                if sy > 1e-14:
                    hy = bend[row] @ y
                    bend[row] += (1 + y @ hy / sy) / sy * np.outer(s, s) - (np.outer(hy, s) + np.outer(s, hy)) / sy
                flat[row] = flat[row] + 1 if value[row] - v_new < 1e-10 else 0
                z[row], value[row], slope[row] = z_new, v_new, g_new
                done[row] = np.abs(g_new).max() < tolerance or flat[row] > 2
            open_ = open_[~good]
            if not len(open_):
                break
            step[open_] *= 0.5
        done[rows[open_]] = np.abs(slope[rows[open_]]).max(1) < 1e-5 if len(open_) else done[rows[open_]]
        if len(open_):
            bend[rows[open_]] = np.eye(k)  # no step falls: begin anew along the slope, at most until the steps run out
    return z, done


def fit_batch(series: list[np.ndarray], p: int, q: int, with_mean: bool, starts: np.ndarray) -> list[Fit]:
    """Maximum-likelihood fits of all series; ``starts`` has a row (ar, ma) for each."""
    batch = _Batch(series, p, q, with_mean)
    z = np.concatenate([to_partial(starts[:, :p]), to_partial(-starts[:, p:]), np.zeros((len(series), int(with_mean)))], 1)
    z, done = _minimise(batch, z)
    ar, ma, mean = batch.parts(z)
    squares, logs = batch.squares_and_logs(np.arange(len(series)), z)
    errors = batch.errors(z)
    out = []
    for i, s in enumerate(series):
        n = len(s)
        sigma2 = float(squares[i]) / n * batch.spread[i] ** 2
        log_lik = -n / 2 * (np.log(2 * np.pi * max(sigma2, 1e-12)) + 1) - 0.5 * float(logs[i])
        out.append(Fit(
            float(batch.center[i] + batch.spread[i] * mean[i]), ar[i], ma[i], sigma2, log_lik,
            errors[i, batch.start[i]:] * batch.spread[i], bool(done[i])))
    return out
