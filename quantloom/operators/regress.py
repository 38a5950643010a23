"""Regressions of returns on factors: one per date, predictions, validation over time.

Fits need only counts, means and covariances. Spark adds those up, so what a
task solves is a matrix of the number of factors squared, and no date or fold
is gathered whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.panel import numbered_dates

KINDS = ("ols", "ridge", "lasso", "elastic_net")
#: Singular values of a covariance matrix up to this share of the largest are rounding noise.
NOISE = 1e-12
#: Half of the ranks that approximate bounds of a median leave open, and their accuracy.
AROUND, ACCURACY = 1e-3, 10_000


def solved(cov: np.ndarray, n: float, kind: str = "ols", alpha: float = 1.0, l1_ratio: float = 0.5, rounds: int = 10_000) -> np.ndarray:
    """Coefficients from the covariances (divided by n) of the columns of x, then y.

    ols: least squares of smallest norm. ridge: |y - xw|^2 + alpha |w|^2.
    lasso and elastic_net: |y - xw|^2 / 2n + alpha (l1_ratio |w|_1 + (1 - l1_ratio) |w|^2 / 2),
    by coordinate descent. x and y are centred: an intercept isn't penalised.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown regression {kind!r}")
    g, b = cov[:-1, :-1], cov[:-1, -1]
    if kind == "ols":
        return np.linalg.pinv(g, rcond=NOISE, hermitian=True) @ b
    if kind == "ridge":
        return np.linalg.solve(g * n + alpha * np.eye(len(b)), b * n)
    l1 = alpha if kind == "lasso" else alpha * l1_ratio
    l2 = 0.0 if kind == "lasso" else alpha * (1 - l1_ratio)
    w = np.zeros(len(b))
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(b)):
            if g[j, j] + l2 > 0:
                r = b[j] - g[j] @ w + g[j, j] * w[j]
                w[j] = np.sign(r) * max(abs(r) - l1, 0.0) / (g[j, j] + l2)
        if np.abs(w - before).max(initial=0) < 1e-12:
            break
    return w


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _square(flat: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for (i, j), v in zip(_pairs(k), flat, strict=True):
        out[i, j] = out[j, i] = v
    return out


def per_date(df: DataFrame, factors: list[str], y: str = "fwd", kind: str = "ols", alpha: float = 1.0, l1_ratio: float = 0.5) -> DataFrame:
    """ts, const_term, beta (array in the order of factors), rsquared, adj_rsquared, rmse, n_obs.

    Rows with a null are left out, and dates with fewer rows than coefficients.
    Without variance in y, rsquared is null (ols) or 0. Only ols has adj_rsquared.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown regression {kind!r}")
    names, k = [*factors, y], len(factors)
    rows = df.select("ts", *names).na.drop("any")
    sums = rows.groupBy("ts").agg(
        F.count("*").alias("n"),
        F.array(*[F.avg(c) for c in names]).alias("m"),
        F.array(*[F.covar_pop(names[i], names[j]) for i, j in _pairs(k + 1)]).alias("c"),
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for ts, n, m, c in zip(b["ts"], b["n"], b["m"], b["c"], strict=True):
                cov = _square(c, k + 1)
                w = solved(cov, n, kind, alpha, l1_ratio)
                off = np.append(-w, 1.0)
                mse, var = max(0.0, float(off @ cov @ off)), float(cov[-1, -1])
                r2 = 1 - mse / var if var > 0 else (None if kind == "ols" else 0.0)
                adj = 1 - (1 - r2) * (n - 1) / (n - k - 1) if kind == "ols" and r2 is not None and n > k + 1 else None
                out.append((ts, m[-1] - m[:-1] @ w, w.tolist(), r2, adj, mse**0.5, n))
            yield pd.DataFrame(out, columns=["ts", "const_term", "beta", "rsquared", "adj_rsquared", "rmse", "n_obs"])

    return sums.where(F.col("n") >= k + 1).mapInPandas(solve, "ts date, const_term double, beta array<double>, rsquared double, adj_rsquared double, rmse double, n_obs long")


def one_factor(df: DataFrame, x: str, y: str = "fwd") -> DataFrame:
    """per_date() for one factor by least squares, without leaving the JVM."""
    rows = df.select("ts", x, y).na.drop("any")
    r2 = F.regr_r2(y, x)
    out = rows.groupBy("ts").agg(F.regr_intercept(y, x).alias("const_term"), F.regr_slope(y, x).alias("beta"), r2.alias("rsquared"), F.regr_syy(y, x).alias("_syy"), F.count("*").alias("n_obs"))
    adj = F.when(F.col("n_obs") > 2, 1 - (1 - F.col("rsquared")) * (F.col("n_obs") - 1) / F.nullif(F.col("n_obs") - 2, F.lit(0)))
    return out.where("n_obs >= 2").select("ts", "const_term", "beta", "rsquared", adj.alias("adj_rsquared"), F.sqrt(F.col("_syy") * (1 - F.col("rsquared")) / F.col("n_obs")).alias("rmse"), "n_obs")


def medians(df: DataFrame, names: list[str]) -> DataFrame:
    """One row: the exact median of each column, null without values.

    A first pass gives approximate bounds; a second one counts what lies below
    and, between the bounds, each value. A five-hundredth of the ranks is left
    between them, so even a panel of 4 billion cells orders some 10 million values.
    """
    near = df.agg(*[F.percentile_approx(c, F.array(F.lit(0.5 - AROUND), F.lit(0.5 + AROUND)), ACCURACY).alias(c) for c in names])
    ends = near.select(F.inline(F.array(*[F.struct(F.lit(c).alias("_c"), F.get(c, F.lit(0)).alias("_low"), F.get(c, F.lit(1)).alias("_high")) for c in names])))
    long = df.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "_c", "_v").where("_v is not null")
    place = F.when(F.col("_v") < F.col("_low"), float("-inf")).when(F.col("_v") > F.col("_high"), float("inf")).otherwise(F.col("_v"))
    counts = long.join(F.broadcast(ends), "_c").groupBy("_c", place.alias("_v")).agg(F.count("*").alias("_n"))
    up = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_c").orderBy("_v"))).withColumn("_all", F.sum("_n").over(Window.partitionBy("_c")))
    holds = lambda rank: (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
    middle = up.groupBy("_c").agg(*[F.min(F.when(holds(F.floor((F.col("_all") - 1 + i) / 2)), F.col("_v"))).alias(f"_m{i}") for i in (0, 1)])
    return middle.agg(*[F.max(F.when(F.col("_c") == c, (F.col("_m0") + F.col("_m1")) / 2)).alias(c) for c in names])


def imputed(df: DataFrame, factors: list[str], default: float = 0.0) -> DataFrame:
    """Null factors replaced by the date's median, else that of all rows, else default."""
    whole = medians(df, factors).select(*[F.col(c).alias(f"_m_{c}") for c in factors])
    by = Window.partitionBy("ts")
    out = df.join(F.broadcast(whole)).withColumns({c: F.coalesce(c, F.percentile(c, 0.5).over(by), f"_m_{c}", F.lit(default)) for c in factors})
    return out.drop(*[f"_m_{c}" for c in factors])


def predicted(df: DataFrame, coefficients: DataFrame, factors: list[str]) -> DataFrame:
    """ts, stock, prediction: the mean coefficients of per_date() applied to imputed
    factors. Running it is an error if no date was fitted."""
    finite = lambda c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    fitted = F.coalesce(F.avg("const_term"), F.raise_error(F.lit("no date was fitted")).cast("double"))
    means = coefficients.agg(fitted.alias("_c"), *[F.avg(F.get("beta", F.lit(i))).alias(f"_b{i}") for i in range(len(factors))])
    total = sum((F.col(c) * finite(f"_b{i}") for i, c in enumerate(factors)), finite("_c"))
    return imputed(df.select("ts", "stock", *factors), factors).join(F.broadcast(means)).select("ts", "stock", total.alias("prediction"))


def folds(n: int, train: int, val: int, step: int, kind: str = "expanding") -> list[tuple[int, int, int, int]]:
    """Row ranges (train from, to, validation from, to; ends exclusive) that walk forward over n dates."""
    if kind not in ("expanding", "rolling"):
        raise ValueError(f"unknown kind {kind!r}")
    return [(0 if kind == "expanding" else end - train, end, end, end + val) for end in range(train, n - val + 1, step)]


def walk_forward_folds(df: DataFrame, train: int, val: int, step: int, kind: str = "expanding") -> DataFrame:
    """fold, train_from, train_to, val_from, val_to: dates, both included."""
    d = numbered_dates(df)
    n = d.count()
    rows = [(i, *f) for i, f in enumerate(folds(n, train, val, step, kind))]
    spans = df.sparkSession.createDataFrame(rows, "fold int, a int, b int, c int, e int")
    at = lambda x, ok: F.min(F.when(ok, F.col("ts"))).alias(x)
    rn = F.col("rn")
    return spans.join(d, (rn == F.col("a")) | (rn == F.col("b") - 1) | (rn == F.col("c")) | (rn == F.col("e") - 1)).groupBy("fold").agg(
        at("train_from", rn == F.col("a")), at("train_to", rn == F.col("b") - 1), at("val_from", rn == F.col("c")), at("val_to", rn == F.col("e") - 1)
    )


def _validated(df: DataFrame, train: int, val: int, step: int, kind: str) -> DataFrame:
    """ts, part: the dates on which each fold validates."""
    d = numbered_dates(df)
    spans = df.sparkSession.createDataFrame([(i, c, e) for i, (_, _, c, e) in enumerate(folds(d.count(), train, val, step, kind))], "part int, c int, e int")
    return spans.select("part", F.explode(F.sequence(F.col("c"), F.col("e") - 1)).alias("rn")).join(d.select("ts", "rn"), "rn").select("ts", "part")


def _date_sums(df: DataFrame, factors: list[str], y: str) -> DataFrame:
    """ts, s: per date the sums of products of (1, factors, y) over complete rows."""
    names = ["_one", *factors, y]
    rows = df.select("ts", *factors, y).na.drop("any").withColumn("_one", F.lit(1.0))
    return rows.groupBy("ts").agg(F.array(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in _pairs(len(names))]).alias("s"))


def _added(s: Column | str, k: int) -> Column:
    return F.array(*[F.sum(F.get(s, F.lit(i))) for i in range(len(_pairs(k)))])


def _errors(parts: DataFrame, k: int, kind: str, alphas: list[float], l1_ratio: float) -> DataFrame:
    """part, alpha, w (intercept, then coefficients), train_mse, val_mse of fits of each
    part. parts: part, seen and held (sums of products of training and validation rows)."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for part, seen, held in zip(b["part"], b["seen"], b["held"], strict=True):
                a, v = _square(seen, k + 2), _square(held, k + 2)
                m = a[0, 1:] / a[0, 0]
                for alpha in alphas:
                    w = solved(a[1:, 1:] / a[0, 0] - np.outer(m, m), a[0, 0], kind, alpha, l1_ratio)
                    w = np.append(m[-1] - m[:-1] @ w, w)
                    c = np.append(-w, 1.0)
                    out.append((int(part), alpha, w.tolist(), c @ a @ c / a[0, 0], c @ v @ c / v[0, 0]))
            yield pd.DataFrame(out, columns=["part", "alpha", "w", "train_mse", "val_mse"])

    return parts.select("part", "seen", "held").mapInPandas(solve, "part int, alpha double, w array<double>, train_mse double, val_mse double")


ALPHAS = (0.001, 0.01, 0.1, 1.0, 10.0)


def kfold_tuned(df: DataFrame, factors: list[str], y: str = "fwd", kind: str = "ridge", alphas: tuple[float, ...] = ALPHAS, k: int = 5, l1_ratio: float = 0.5) -> DataFrame:
    """alpha, val_mse, best: mean error over k folds of consecutive dates.

    Rows are added up once, by date; folds are sums of dates.
    """
    size = len(factors) + 2
    d = numbered_dates(df).select("ts", F.floor(F.col("rn") * k / F.col("n")).cast("int").alias("part"))
    own = _date_sums(df, factors, y).join(F.broadcast(d), "ts").groupBy("part").agg(_added("s", size).alias("held"))
    whole = own.agg(_added("held", size).alias("_all"))
    parts = own.join(F.broadcast(whole)).withColumn("seen", F.zip_with("_all", "held", lambda a, b: a - b))
    mean = _errors(parts, len(factors), kind, list(alphas), l1_ratio).groupBy("alpha").agg(F.avg("val_mse").alias("val_mse"))
    return mean.withColumn("best", F.col("val_mse") == F.min("val_mse").over(Window.partitionBy()))


def walk_forward_tuned(df: DataFrame, factors: list[str], train: int, val: int, step: int, y: str = "fwd", kind: str = "ridge", alphas: tuple[float, ...] = ALPHAS, how: str = "expanding", l1_ratio: float = 0.5) -> DataFrame:
    """alpha, train_mse, val_mse, val_mae, val_rmse, val_rmse_sd, best: means over folds that walk forward.

    Rows are added up once, by date; only absolute errors go back to the rows,
    each once for every fold that validates on its date.
    """
    size = len(factors) + 2
    spans = walk_forward_folds(df, train, val, step, how)
    dates = _date_sums(df, factors, y).join(F.broadcast(spans), F.col("ts").between(F.col("train_from"), F.col("val_to"))).where("ts <= train_to or ts >= val_from")
    of = dates.groupBy(F.col("fold").alias("part"), (F.col("ts") >= F.col("val_from")).alias("_val")).agg(_added("s", size).alias("s"))
    parts = of.groupBy("part").agg(F.max(F.when(~F.col("_val"), F.col("s"))).alias("seen"), F.max(F.when(F.col("_val"), F.col("s"))).alias("held")).where("seen is not null and held is not null")
    e = _errors(parts, len(factors), kind, list(alphas), l1_ratio).withColumn("rmse", F.sqrt("val_mse"))
    asked = _validated(df, train, val, step, how).join(e.select("part", "alpha", "w"), "part")
    held = df.select("ts", *factors, y).na.drop("any").join(asked, "ts")
    guess = sum((F.col(c) * F.get("w", F.lit(i + 1)) for i, c in enumerate(factors)), F.get("w", F.lit(0)))
    mae = held.groupBy("part", "alpha").agg(F.avg(F.abs(F.col(y) - guess)).alias("mae"))
    e = e.join(mae, ["part", "alpha"])
    mean = e.groupBy("alpha").agg(F.avg("train_mse").alias("train_mse"), F.avg("val_mse").alias("val_mse"), F.avg("mae").alias("val_mae"), F.avg("rmse").alias("val_rmse"), F.stddev_pop("rmse").alias("val_rmse_sd"))
    return mean.withColumn("best", F.col("val_rmse") == F.min("val_rmse").over(Window.partitionBy()))
