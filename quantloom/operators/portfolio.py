"""Mean-variance portfolios, one for each rebalancing date."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.ts import ffill
from quantloom.operators.panel import densify, every
from quantloom.operators.risk import SHARE, WORST, Model, _settled, judged, root, spread, square
from quantloom.session import written

#: Excess returns up to this are none.
NONE = 1e-8
#: A solution is one if no weight would move by more in a step of the gradient.
TOLERANCE, ROUNDS = 1e-9, 50_000


def projected(v: np.ndarray, low: float, high: float, scale: np.ndarray | float = 1.0) -> np.ndarray:
    """scale (v - t) clipped to [low, high] (either may be infinite), with the shift t at which the
    parts add up to 1; without scale, the nearest such point to v. The sum falls piecewise linearly
    with the shift, so the right piece is searched and the shift interpolated."""
    return np.clip(scale * (v - _shift(v, low, high, scale)), low, high)


def _shift(v: np.ndarray, low: float, high: float, scale: np.ndarray | float) -> float:
    total = lambda t: np.clip(scale * (v - t), low, high).sum()
    free = lambda: ((scale * v).sum() - 1) / (scale * np.ones(len(v))).sum()
    at = np.sort(np.concatenate([v - x / scale for x in (high, low) if np.isfinite(x)] or [v]))
    if total(at[0]) < 1 and not np.isfinite(high):  # no part is clipped from below
        return free()
    if total(at[-1]) > 1:  # and here none from above
        return free()
    a, b = 0, len(at) - 1
    while b - a > 1:
        m = (a + b) // 2
        a, b = (m, b) if total(at[m]) > 1 else (a, m)
    sa, sb = total(at[a]), total(at[b])
    return at[a] if sa <= sb else at[a] + (sa - 1) / (sa - sb) * (at[b] - at[a])


def solve(mu: np.ndarray, z: np.ndarray, d: np.ndarray, aversion: float = 2.5, cap: float | None = None, short: bool = False, rounds: int = ROUNDS) -> tuple[np.ndarray | None, float]:
    """Weights that maximise mu w - aversion / 2 w V w with V = z z' + diag(d), adding up to
    1, between 0 (without bound, if short) and cap; and the residual of the
    optimality conditions: how far a step of the gradient moves a weight. None
    if the cap is too small. V itself isn't made: with a price for each factor (y)
    and one for the sum, weights are clipped one by one, so Newton's method takes
    the dual problem in one variable a factor; a round passes over the stocks.
    """
    n, high, low = len(mu), np.inf if cap is None else cap, -np.inf if short else 0.0
    if n * high < 1:
        return None, np.inf
    scale = 1 / (aversion * np.maximum(d, 1e-15))
    grad = lambda w: mu - aversion * (z @ (z.T @ w) + d * w)
    step = 1 / (aversion * max(float(np.linalg.eigvalsh(z.T @ z)[-1]) + float(d.max()), 1e-12))  # an upper bound of V's eigenvalues

    def at(y: np.ndarray) -> tuple[float, np.ndarray]:
        """The dual value to minimise, and the weights, at prices y."""
        s = mu - z @ y
        w = projected(s, low, high, scale)
        return float(s @ w - (w * w / scale).sum() / 2 + y @ y / (2 * aversion)), w

    y = aversion * (z.T @ np.full(n, 1 / n))
    value, w = at(y)
    done = 1
    while done < rounds:
        slope = y / aversion - z.T @ w
        free = np.where((w > low) & (w < high), scale, 0.0)
        both = z.T @ free
        curve = np.eye(len(y)) / aversion + (z * free[:, None]).T @ z - (np.outer(both, both) / free.sum() if free.any() else 0.0)
        move = -np.linalg.solve(curve, slope)
        gain, length = float(slope @ move), 1.0
        while done < rounds:
            new, new_w = at(y + length * move)
            done += 1
            if new <= value + 1e-4 * length * gain or length < 1e-6:
                break
            length = min(length / 2, max(length / 20, -gain * length * length / (2 * (new - value - length * gain))))  # the least of a parabola
        if new >= value:  # no further than rounding
            break
        y, value, w = y + length * move, new, new_w
    w = projected(w, low, high)
    return w, float(np.abs(projected(w + step * grad(w), low, high) - w).max())


def optimized(pred: DataFrame, model: Model, k: int, rf: DataFrame | None = None, interval: int = 5, h: int = 1, aversion: float = 2.5, cap: float | None = None, short: bool = False, keep_short: bool = False) -> DataFrame:
    """ts, stock, weight, residual, status on every interval-th date of pred (ts, stock, prediction)
    that has a prediction, for all stocks of the model (of k factors).

    Stocks without a prediction count with 0, before the risk-free rate (rf: ts,
    rf). One covariance serves all dates: z z' + diag(d), which isn't multiplied
    out, so a date's stocks take as many numbers each as there are factors in a
    task. Without any return over the risk-free rate (status none), if no
    weights fit the cap (capped), or if the solver doesn't converge (diverged),
    weights are equal and residual is null. Else residual tells how far a step
    of the gradient still moves a weight. Weights are cut at 0 and scaled to 1
    unless keep_short.
    """
    fm = square(model.fcov, k)
    some = written(every(pred, interval).where("prediction is not null and not isnan(prediction)"))  # few dates
    dates = some.select("ts").distinct()
    stocks = model.x.join(model.spec, "stock", "left")
    rows = stocks.join(F.broadcast(dates)).join(some.select("ts", "stock", "prediction"), ["ts", "stock"], "left")
    rows = rows.join(F.broadcast(rf.select("ts", "rf")), "ts", "left") if rf is not None else rows.withColumn("rf", F.lit(0.0))

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("stock")
        n = len(rows)
        column = lambda c: rows.column(c).to_numpy()
        if fm is None:
            z, d = np.zeros((n, 1)), np.ones(n)
        else:
            g = root(fm)
            g = g[:, (g * g).sum(0) > 1e-15 * (g * g).sum()]  # what is left out is rounding: industries without stocks, mostly
            z = rows.column("x").combine_chunks().flatten().to_numpy().reshape(n, -1) @ g
            d = np.where(np.isnan(column("var").astype(float)), 1e-6, column("var").astype(float))
            if judged(*spread(z, d, lambda a, b: _settled(a, b, WORST))) is not False:  # drawn to the diagonal
                d = d + SHARE * (z * z).sum(1)
                z = z * np.sqrt(1 - SHARE)
            z, d = z * np.sqrt(h), d * h
        mu = np.nan_to_num(column("prediction").astype(float), nan=0.0, posinf=0.0, neginf=0.0) - float(np.nan_to_num(column("rf").astype(float)[0]))
        w, left, status = None, np.nan, "none"
        if np.abs(mu).max() > NONE:
            w, left = solve(mu, z, d + 1e-8, aversion, cap, short)
            status = "capped" if w is None else "solved" if left <= TOLERANCE else "diverged"
        if status != "solved":
            w, left = np.full(n, 1 / n), np.nan
        elif not keep_short:
            w = np.clip(w, 0, None)
            w = w / w.sum() if w.sum() > 0 else np.full(n, 1 / n)
        return pa.table({"ts": rows.column("ts"), "stock": rows.column("stock"), "weight": w, "residual": pa.array(np.full(n, left), from_pandas=True), "status": pa.array([status] * n)})

    return rows.groupBy("ts").applyInArrow(one, f"ts date, stock {dict(pred.dtypes)['stock']}, weight double, residual double, status string")


def held(weights: DataFrame, calendar: DataFrame, interval: int) -> DataFrame:
    """weights on all dates of calendar, each kept for interval - 1 dates more."""
    dates = calendar.select("ts").distinct().withColumn("stock", F.lit(None).cast(dict(weights.dtypes)["stock"])).withColumn("weight", F.lit(None).cast("double"))
    dense = densify(weights.unionByName(dates)).where("stock is not null")
    return dense.withColumn("weight", ffill("weight", interval - 1))
