"""ARIMA(p, d, q) per series: numeric fits of many series at once in a task, recursion as a SQL fold."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.forecast.batches import map_series, series_starts
from panelcast.forecast.likelihood import fit_batch
from panelcast.spec import SeriesSpec

Order = tuple[int, int, int]

# Orders tried in turn after the requested one.
FALLBACK_ORDERS: tuple[Order, ...] = ((1, 1, 1), (0, 1, 1), (1, 1, 0), (0, 1, 0), (1, 0, 0))

LEAST_OBSERVATIONS = 3


def _innovations(w: np.ndarray, const: float, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """One-step errors, with everything before the sample at its mean."""
    x = w - const
    e = x.copy()
    for i, phi in enumerate(ar, start=1):
        e[i:] -= phi * x[:-i]
    if len(ma) == 1:
        theta, last = float(ma[0]), 0.0
        out = e.tolist()
        for t, value in enumerate(out):
            out[t] = last = value - theta * last
        e = np.array(out)
    elif len(ma):
        out, theta = e.tolist(), ma.tolist()
        for t in range(1, len(out)):
            for j, th in enumerate(theta[:t], start=1):
                out[t] -= th * out[t - j]
        e = np.array(out)
    return e


def _stable(poly: np.ndarray) -> bool:
    """Whether 1 - c1 z - … has all roots outside the unit circle."""
    return not len(poly) or bool(np.all(np.abs(np.roots(np.r_[1.0, -poly])) < 0.999))


def _least_squares(rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(rows, target, rcond=None)[0]


def _start(x: np.ndarray, p: int, q: int) -> np.ndarray:
    """Hannan-Rissanen: long autoregression for the errors, then regression on lags of both."""
    m = max(p, q)
    if m == 0:
        return np.zeros(0)
    long = min(max(2 * m, 10), len(x) // 3) if q else 0
    e = np.zeros_like(x)
    if long:
        lags = np.column_stack([x[long - i : len(x) - i] for i in range(1, long + 1)])
        e[long:] = x[long:] - lags @ _least_squares(lags, x[long:])
    first = long + m
    if len(x) - first <= p + q:
        return np.zeros(p + q)
    columns = [x[first - i : len(x) - i] for i in range(1, p + 1)]
    columns += [e[first - j : len(e) - j] for j in range(1, q + 1)]
    beta = _least_squares(np.column_stack(columns), x[first:])
    for _ in range(20):
        if _stable(beta[:p]) and _stable(-beta[p:]):
            return beta
        beta = beta * 0.8
    return np.zeros(p + q)


def fit_css(y: np.ndarray, order: Order, iterations: int = 300) -> dict:
    """Conditional-sum-of-squares fit by damped Gauss-Newton steps inside the stable region.

    ``converged`` is false when the steps ran out while the sum of squares still fell.
    """
    p, d, q = order
    if min(order) < 0 or d > 2:
        raise ValueError(f"unsupported order {order}")
    w = np.diff(y, n=d) if d else y
    use_const = d == 0
    if len(w) < p + q + 1 + int(use_const):
        raise ValueError(f"{len(y)} observations are too few for order {order}")
    const = float(w.mean()) if use_const else 0.0
    beta = np.r_[[const] if use_const else [], _start(w - const, p, q)]
    k = int(use_const)

    def errors(b: np.ndarray) -> np.ndarray:
        return _innovations(w, b[0] if k else 0.0, b[k : k + p], b[k + p :])

    def admissible(b: np.ndarray) -> bool:
        return _stable(b[k : k + p]) and _stable(-b[k + p :])

    e = errors(beta)
    sse = float(e @ e)
    scale = max(float(np.std(w)), 1e-8)
    converged = not len(beta)
    for _ in range(iterations if len(beta) else 0):
        jac = np.empty((len(w), len(beta)))
        for i in range(len(beta)):
            h = 1e-6 * (scale if i < k else 1.0)
            moved = beta.copy()
            moved[i] += h
            jac[:, i] = (errors(moved) - e) / h
        move = _least_squares(jac, -e)
        damp, better = 1.0, None
        while damp > 1e-4:
            trial = beta + damp * move
            if admissible(trial):
                e_trial = errors(trial)
                if float(e_trial @ e_trial) < sse:
                    better = (trial, e_trial)
                    break
            damp /= 2
        if better is None:
            converged = True
            break
        beta, e = better
        gain, sse = sse - float(e @ e), float(e @ e)
        if gain <= 1e-10 * max(sse, 1e-12):
            converged = True
            break
    n = len(w)
    sigma2 = sse / n
    log_lik = -n / 2 * (np.log(2 * np.pi * max(sigma2, 1e-12)) + 1)
    n_params = len(beta) + 1
    const = float(beta[0]) if k else 0.0
    return {
        "const": const, "ar": beta[k : k + p], "ma": beta[k + p :], "sigma2": sigma2,
        "aic": 2 * n_params - 2 * log_lik, "bic": n_params * np.log(n) - 2 * log_lik,
        "w": w - const, "resid": e, "converged": converged,
    }


def too_few(n: int, order: Order) -> bool:
    """Whether ``n`` observations leave too few after differencing for the parameters of an order."""
    p, d, q = order
    return n - d < p + q + 1 + int(d == 0)


def fit_exact(ys: Sequence[np.ndarray], order: Order) -> list[dict]:
    """Maximum-likelihood fits of one order to many series, all in step; same entries as ``fit_css``.

    The constant is a mean and only fitted without differencing.
    """
    p, d, q = order
    if min(order) < 0 or d > 2:
        raise ValueError(f"unsupported order {order}")
    if any(too_few(len(y), order) for y in ys):
        raise ValueError(f"too few observations for order {order}")
    ws = [np.diff(y, n=d) if d else y for y in ys]
    starts = np.stack([_start(w - (w.mean() if d == 0 else 0.0), p, q) for w in ws])
    out = []
    for w, fit in zip(ws, fit_batch(ws, p, q, d == 0, starts)):
        n_params = p + q + int(d == 0) + 1
        out.append({
            "const": fit.const, "ar": fit.ar, "ma": fit.ma, "sigma2": fit.sigma2, "aic": 2 * n_params - 2 * fit.log_lik,
            "bic": n_params * np.log(len(w)) - 2 * fit.log_lik, "w": w - fit.const, "resid": fit.resid, "converged": fit.converged,
        })
    return out


def _fit_css_all(ys: Sequence[np.ndarray], order: Order) -> list[dict]:
    return [fit_css(y, order) for y in ys]


METHODS = {"exact": fit_exact, "css": _fit_css_all}


def fit_many(ys: Sequence[np.ndarray], order: Order, method: str = "exact") -> list[tuple[Order, dict] | str]:
    """For each series the first order that converges, or the first that could be fitted at all; else the reason as text.

    All series that still need a fit try an order together.
    """
    fit = METHODS[method]
    found: list = [None] * len(ys)
    unfinished: dict[int, tuple[Order, dict]] = {}
    open_ = []
    for i, y in enumerate(ys):
        broken = int((~np.isfinite(y)).sum())
        if len(y) < LEAST_OBSERVATIONS:
            found[i] = f"a series of {len(y)} values is too short to fit, {LEAST_OBSERVATIONS} are needed"
        elif broken:
            found[i] = f"{broken} of the values cannot be used, as they are missing or infinite"
        else:
            open_.append(i)
    for candidate in dict.fromkeys((tuple(order), *FALLBACK_ORDERS)):
        able = [i for i in open_ if found[i] is None and not too_few(len(ys[i]), candidate)]
        if not able:
            continue
        try:
            fits = fit([ys[i] for i in able], candidate)
        except np.linalg.LinAlgError:  # one series can spoil a batch: take them one by one
            fits = []
            for i in able:
                try:
                    fits += fit([ys[i]], candidate)
                except np.linalg.LinAlgError:
                    fits.append(None)
        for i, one in zip(able, fits):
            if one is None:
                continue
            if one["converged"]:
                found[i] = (candidate, one)
            else:
                unfinished.setdefault(i, (candidate, one))
    return [f or unfinished.get(i) or "no order could be fitted" for i, f in enumerate(found)]


def fit_with_fallback(y: np.ndarray, order: Order, method: str = "exact") -> tuple[Order, dict]:
    """``fit_many`` for one series; raises where it cannot be fitted."""
    found = fit_many([y], order, method)[0]
    if isinstance(found, str):
        raise ValueError(found)
    return found


def params_schema(df: DataFrame, spec: SeriesSpec) -> T.StructType:
    number, numbers = T.DoubleType(), T.ArrayType(T.DoubleType())
    fields = [df.schema[k] for k in spec.keys]
    fields += [
        T.StructField("order", T.ArrayType(T.IntegerType())), T.StructField("const", number),
        T.StructField("ar", numbers), T.StructField("ma", numbers), T.StructField("sigma2", number),
        T.StructField("aic", number), T.StructField("bic", number), T.StructField("n_train", T.LongType()),
        T.StructField("last_date", T.DateType()), T.StructField("w_tail", numbers), T.StructField("e_tail", numbers),
        T.StructField("level", number), T.StructField("slope", number),
        T.StructField("resid_dates", T.ArrayType(T.DateType())), T.StructField("resid", numbers),
        T.StructField("status", T.StringType()), T.StructField("reason", T.StringType()),
        T.StructField("converged", T.BooleanType()),
    ]
    return T.StructType(fields)


def fit_arima(
    train: DataFrame, spec: SeriesSpec, order: Order = (1, 1, 1), min_rows: int = LEAST_OBSERVATIONS, method: str = "exact"
) -> DataFrame:
    """Fit every series in parallel; one row per series with parameters, residuals and status.

    A task takes whole series in batches and fits a batch together. A failing series is reported, not raised. Rows are one per
    period, so a series is bounded by the calendar.
    """
    if not isinstance(train.schema[spec.date].dataType, T.DateType):
        raise ValueError("forecasts are daily: clean the series at day grain first")
    if min(order) < 0 or order[1] > 2:
        raise ValueError(f"unsupported order {tuple(order)}")
    schema = params_schema(train, spec)
    keys = list(spec.keys)
    names = schema.fieldNames()
    date_col, demand_col, order = spec.date, spec.demand, tuple(order)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        starts = series_starts(rows, keys)
        stops = np.append(starts[1:], len(rows))
        values, dates = rows[demand_col].to_numpy(dtype=float), rows[date_col].to_numpy()
        heads = rows.iloc[starts][keys].to_dict("records")
        series = [values[a:b] for a, b in zip(starts, stops)]
        long = [i for i, y in enumerate(series) if len(y) >= min_rows]
        fits = dict(zip(long, fit_many([series[i] for i in long], order, method)))
        out = []
        for i, (a, b, y) in enumerate(zip(starts, stops, series)):
            row: dict = dict.fromkeys(names)
            row.update(heads[i], n_train=len(y), last_date=dates[b - 1])
            found = fits.get(i)
            if found is None:
                row.update(status="skipped", reason=f"{len(y)} periods, needs {min_rows}")
            elif isinstance(found, str):
                row.update(status="failed", reason=f"no fit: {found}")
            else:
                used, one = found
                p, d, q = used
                row.update(
                    order=list(used), const=one["const"], ar=list(one["ar"]), ma=list(one["ma"]),
                    sigma2=one["sigma2"], aic=one["aic"], bic=one["bic"],
                    # newest first, as the recursion reads them
                    w_tail=list(one["w"][::-1][:p]), e_tail=list(one["resid"][::-1][:q]),
                    level=float(y[-1]), slope=float(y[-1] - y[-2]) if d > 1 else 0.0,
                    resid_dates=list(dates[a + d:b]), resid=list(one["resid"]), status="fitted",
                    converged=bool(one["converged"]),
                )
            out.append(row)
        return pd.DataFrame(out, columns=names)

    return map_series(train.select(*spec.columns), keys, [date_col], fit, schema)


def residuals(params: DataFrame, spec: SeriesSpec) -> DataFrame:
    """In-sample errors in long form. The ``d`` rows lost to differencing have none."""
    pairs = F.arrays_zip("resid_dates", "resid")
    return params.where("status = 'fitted'").select(
        *spec.keys, F.inline(pairs).alias(spec.date, "resid")
    )


def arima_forecast(params: DataFrame, spec: SeriesSpec, steps: int | None = None, horizon: str | None = None) -> DataFrame:
    """Recursive forecast of every fitted series, all steps in one JVM-side fold.

    ``horizon`` names a column with the number of steps per series; otherwise ``steps`` is used.
    """
    p, d, q = (F.expr(f"`order`[{i}]") for i in range(3))
    until = horizon if horizon else str(int(steps))
    product = "aggregate(zip_with({a}, {b}, (x, y) -> coalesce(x * y, 0D)), 0D, (s, v) -> s + v)"
    centred = product.format(a="ar", b="s.w") + " + " + product.format(a="ma", b="s.e")
    # The inner transform names the next centred value, the outer one builds the next state from it.
    fold = f"""
      aggregate(sequence(1, cast({until} as int)),
        named_struct('w', w_tail, 'e', e_tail, 'level', level, 'slope', slope, 'out', cast(array() as array<double>)),
        (s, i) -> transform(transform(array({centred}),
            x -> named_struct('x', x, 'slope', if(_d = 2, s.slope + x, x + `const`))),
            n -> named_struct(
              'w', slice(concat(array(n.x), s.w), 1, _p),
              'e', slice(concat(array(0D), s.e), 1, _q),
              'level', if(_d = 0, n.slope, s.level + n.slope),
              'slope', n.slope,
              'out', concat(s.out, array(if(_d = 0, n.slope, s.level + n.slope)))))[0],
        s -> s.out)
    """
    fitted = params.where(F.col("status") == "fitted")
    if horizon:
        fitted = fitted.where(F.col(horizon) > 0)
    folded = fitted.withColumns({"_p": p, "_d": d, "_q": q}).withColumn("_path", F.expr(fold))
    return folded.select(*spec.keys, "last_date", F.posexplode("_path").alias("_i", "yhat")).select(
        *spec.keys, F.lit("ARIMA").alias("model"), (F.col("_i") + 1).alias("step"),
        F.date_add("last_date", F.col("_i") + 1).alias("date"), "yhat",
    )


def model_info(params: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Order and information criteria per series."""
    return params.select(*spec.keys, "order", "aic", "bic", "converged", "status", "reason")


def fit_counts(params: DataFrame) -> DataFrame:
    return params.groupBy("status").agg(F.count(F.lit(1)).alias("n_series"))
