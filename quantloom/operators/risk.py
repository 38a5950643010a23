"""Factor risk model: covariance of returns as exposures x factor covariance + specific variance."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.ts import daily_return, ffill
from quantloom.operators.panel import numbered_dates
from quantloom.session import written

OTHER = "Other"
#: The 49 industries of the public classification, in its order; stocks of none are in the last.
INDUSTRIES = tuple(
    """Agric Food Soda Beer Smoke Toys Fun Books Hshld Clths Hlth MedEq Drugs Chems Rubbr Txtls BldMt Cnstr Steel FabPr Mach ElcEq Autos Aero Ships
Guns Gold Mines Coal Oil Util Telcm PerSv BusSv Hardw Softw Chips LabEq Paper Boxes Trans Whlsl Rtail Meals Banks Insur RlEst Fin Other""".split()
)
#: Singular values up to this share of the largest are rounding noise.
NOISE = 1e-10
#: How far a badly conditioned matrix is drawn to its diagonal.
SHARE = 0.15
#: Stocks on a side of a block of the covariance matrix.
BLOCK = 512


def ewma_weights(dates: DataFrame, halflife: float) -> DataFrame:
    """ts, weight: halving every `halflife` dates back from the last, adding up to 1."""
    raw = F.exp(F.lit(-math.log(2) / halflife) * (F.col("n") - 1 - F.col("rn")))
    return numbered_dates(dates).withColumn("_raw", raw).select("ts", (F.col("_raw") / F.sum("_raw").over(Window.partitionBy())).alias("weight"))


def industries(df: DataFrame, ranges: DataFrame, sic: str = "sic_code") -> DataFrame:
    """df with industry: that of the first range (low, high, industry, place) that holds the code, else Other.

    Ranges are expanded to single codes (four digits: 10,000 at most), so this is an equi-join.
    """
    codes = ranges.where("low between 0 and 9999 and high between low and 9999").select("industry", "place", F.explode(F.sequence(F.col("low").cast("int"), F.col("high").cast("int"))).alias("_code"))
    first = codes.groupBy("_code").agg(F.min_by("industry", "place").alias("industry"))
    return df.join(F.broadcast(first), F.col(sic).cast("int") == F.col("_code"), "left").select(*[c for c in df.columns if c != "industry"], F.coalesce("industry", F.lit(OTHER)).alias("industry"))


def recent(df: DataFrame, date, window: int = 63) -> DataFrame:
    """The rows of the last window + 1 dates up to `date`: those of window returns."""
    d = numbered_dates(df.where(F.col("ts") <= F.lit(date))).where(F.col("n") - F.col("rn") <= window + 1)
    return df.join(F.broadcast(d.select("ts")), "ts", "left_semi")


def _returns(df: DataFrame, style: list[str], groups: tuple[str, ...]) -> DataFrame:
    """ts, stock, r, g (place of the industry, carried forward, in groups), style
    (nulls as 0), on dates with any return."""
    order = F.array(*[F.lit(g) for g in groups])
    panel = df.withColumn("_r", daily_return("close")).withColumn("_g", ffill("industry"))
    panel = panel.withColumn("_some", F.max(F.col("_r").isNotNull()).over(Window.partitionBy("ts"))).where("_some")
    place = F.nullif(F.array_position(order, F.col("_g")), F.lit(0)) - 1
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return panel.select("ts", "stock", F.coalesce("_r", F.lit(0.0)).alias("r"), place.cast("int").alias("g"), *[zero(c) for c in style])


def factor_returns(df: DataFrame, style: list[str], groups: tuple[str, ...] = INDUSTRIES) -> tuple[DataFrame, DataFrame]:
    """(ts, f: array over style factors, then groups), (ts, stock, e, r): minimum-norm
    regressions of each date's returns on exposures. Null exposures and returns
    count as 0; dates without any return are left out. df: dense panel with
    close, the style columns and industry.

    Spark adds up products by date and industry; a task then solves the normal
    equations of a date, and residuals are made by a join with its solution.
    """
    return _fitted(_returns(df, style, groups), style, groups)


def _fitted(rows: DataFrame, style: list[str], groups: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    k, n = len(style), len(style) + len(groups)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    by_group = rows.groupBy("ts", "g").agg(
        F.count("*").alias("n"),
        F.sum("r").alias("r"),
        F.array(*[F.sum(c) for c in style]).cast("array<double>").alias("s"),
        F.array(*[F.sum(F.col(style[i]) * F.col(style[j])) for i, j in pairs]).cast("array<double>").alias("ss"),
        F.array(*[F.sum(F.col(c) * F.col("r")) for c in style]).cast("array<double>").alias("sr"),
    )
    by_date = by_group.groupBy("ts").agg(F.collect_list(F.struct("g", "n", "r", "s", "ss", "sr")).alias("parts"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for parts in b["parts"]:
                gram, xr = np.zeros((n, n)), np.zeros(n)
                for q in parts:
                    for (i, j), v in zip(pairs, q["ss"], strict=True):
                        gram[i, j] += v
                        gram[j, i] = gram[i, j]
                    xr[:k] += q["sr"]
                    if q["g"] is not None and not pd.isna(q["g"]):
                        at = k + int(q["g"])
                        gram[at, at], xr[at] = q["n"], q["r"]
                        gram[at, :k] = gram[:k, at] = q["s"]
                out.append((np.linalg.pinv(gram, rcond=NOISE, hermitian=True) @ xr).tolist())
            yield pd.DataFrame({"ts": b["ts"], "f": out})

    f = by_date.mapInPandas(solve, "ts date, f array<double>")
    part = lambda i: F.get("f", F.lit(i) if isinstance(i, int) else i)
    told = sum((F.col(c) * part(i) for i, c in enumerate(style)), F.coalesce(part(F.col("g") + k), F.lit(0.0)))
    # one row a date
    return f, rows.join(F.broadcast(f), "ts").select("ts", "stock", (F.col("r") - told).alias("e"), "r")


def factor_covariance(f: DataFrame, halflife: float = 63.0) -> DataFrame:
    """i, j, cov: weighted covariance of the factors' returns over all dates.

    One date gives the identity, none no rows. Each task adds up its dates'
    products, so what moves is K squared numbers a task.
    """
    w = f.join(F.broadcast(ewma_weights(f, halflife)), "ts").select("weight", "f")

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n, ww = None, 0, 0.0
        for b in batches:
            x = np.column_stack([np.ones(len(b)), np.vstack(b["f"].to_numpy())])
            weight = b["weight"].to_numpy(float)
            add = (x * weight[:, None]).T @ x
            total, n, ww = add if total is None else total + add, n + len(b), ww + float(weight @ weight)
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel() - 1, "j": j.ravel() - 1, "s": total.ravel(), "n": n, "ww": ww})

    sums = w.mapInPandas(products, "i int, j int, s double, n long, ww double").groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("ww").alias("ww"))
    mean = sums.where("j = -1").select(F.col("i").alias("_k"), F.col("s").alias("_m"))
    both = sums.where("i >= 0 and j >= 0").join(mean.toDF("i", "_mi"), "i").join(mean.toDF("j", "_mj"), "j")
    same = (F.col("i") == F.col("j")).cast("double")
    return both.select("i", "j", F.when(F.col("n") == 1, same).otherwise((F.col("s") - F.col("_mi") * F.col("_mj")) / (1 - F.col("ww"))).alias("cov"))


def specific_variance(e: DataFrame, window: int = 21, halflife: float = 21.0) -> DataFrame:
    """stock, var: weighted variance of the residuals of the last `window` dates; 1e-6 for a single date."""
    d = numbered_dates(e).where(F.col("rn") >= F.col("n") - window).select("ts")
    w = e.join(F.broadcast(ewma_weights(d, halflife)), "ts")
    g = w.groupBy("stock").agg(F.sum(F.col("weight") * F.col("e") * F.col("e")).alias("ee"), F.sum(F.col("weight") * F.col("e")).alias("m"), F.sum(F.col("weight") * F.col("weight")).alias("ww"), F.count("*").alias("n"))
    return g.select("stock", F.when(F.col("n") == 1, F.lit(1e-6)).otherwise(F.greatest(F.lit(0.0), (F.col("ee") - F.col("m") * F.col("m")) / (1 - F.col("ww")))).alias("var"))


def exposures(df: DataFrame, style: list[str], groups: tuple[str, ...] = INDUSTRIES) -> DataFrame:
    """stock, x: exposures (nulls as 0) on the last date with any return. Stocks
    have none if there is no such date."""
    return _exposed(df, _returns(df, style, groups), style, groups)


def _exposed(df: DataFrame, rows: DataFrame, style: list[str], groups: tuple[str, ...]) -> DataFrame:
    last = rows.join(F.broadcast(rows.agg(F.max("ts").alias("ts"))), "ts").select("stock", F.struct("g", *style).alias("_x"))
    dummies = [F.coalesce(F.col("_x.g") == i, F.lit(False)).cast("double") for i in range(len(groups))]
    x = F.array(*[F.col("_x")[c] for c in style], *dummies)
    return df.select("stock").distinct().join(last, "stock", "left").select("stock", F.when(F.col("_x").isNotNull(), x).alias("x"))


@dataclass(frozen=True)
class Model:
    """x: stock, x. fcov: i, j, cov. spec: stock, var."""

    x: DataFrame
    fcov: DataFrame
    spec: DataFrame


def risk_model(df: DataFrame, style: list[str], groups: tuple[str, ...] = INDUSTRIES, date=None, window: int = 63, specific_window: int = 21) -> Model:
    """The model of all dates of df, or of the returns of the last `window` dates up to
    `date`. The specific variance is of the last `specific_window` of them."""
    df = df if date is None else recent(df, date, window)
    rows = written(_returns(df, style, groups))  # the panel is evaluated once
    f, e = _fitted(rows, style, groups)
    return Model(_exposed(df, rows, style, groups), factor_covariance(f), specific_variance(e, specific_window))


def square(fcov: DataFrame, k: int) -> np.ndarray | None:
    """The matrix of (i, j, cov), K squared numbers; None for no rows."""
    rows = fcov.collect()
    m = np.zeros((k, k))
    for i, j, c in rows:
        m[i, j] = c
    return m if rows else None


#: Points at which eigenvalues are counted in one pass over stocks.
POINTS = 24
#: A matrix is badly conditioned if its least eigenvalue is no larger than this, or the largest is so many times as large.
TINY, WORST = 1e-12, 1e4


def root(fm: np.ndarray) -> np.ndarray:
    """g with g g' = fm (symmetric; what rounding made negative counts as zero)."""
    w, v = np.linalg.eigh((fm + fm.T) / 2)
    return v * np.sqrt(np.maximum(w, 0))


def pivots(z: np.ndarray, d: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What counting eigenvalues needs of stocks (z: exposures times root(), d: specific
    variances) at each of the points: how many d lie below it, and the sum of z' z / (d - point)."""
    gap = d[None, :] - at[:, None]
    gap = np.where(gap == 0, 1e-300, gap)
    return (gap < 0).sum(1), np.array([(z / g[:, None]).T @ z for g in gap])


def counted(below: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """How many eigenvalues of z z' + diag(d) lie below each point: as many as d do,
    less the negative ones of the Schur complement, which has one row a factor."""
    return below - (np.linalg.eigvalsh(np.eye(sums.shape[1]) + sums) < 0).sum(1)


def bracketed(count: Callable[[np.ndarray], np.ndarray], n: int, low: tuple[float, float], high: tuple[float, float], done: Callable[..., bool], rounds: int = 40) -> tuple[tuple[float, float], tuple[float, float]]:
    """Intervals of the least and of the largest of n eigenvalues, narrowed by counting
    the eigenvalues below POINTS points at a time until done(low, high)."""
    for _ in range(rounds):
        if done(low, high):
            break
        inside = [np.geomspace(max(a, 1e-300), b, POINTS // 2 + 2)[1:-1] for a, b in (low, high)]
        found = count(np.concatenate(inside))
        cut = []
        for points, n_below, need, (a, b) in ((inside[0], found[: len(inside[0])], 1, low), (inside[1], found[len(inside[0]) :], n, high)):
            some = np.flatnonzero(n_below >= need)
            k = some[0] if len(some) else len(points)
            cut.append((points[k - 1] if k else a, points[k] if k < len(points) else b))
        low, high = cut
    return low, high


def _bounds(d_low: float, d_high: float, own_low: float, own_high: float, cross: np.ndarray) -> tuple[tuple[float, float], tuple[float, float]]:
    """Where the least and the largest eigenvalue lie, from the extremes of d, those of the diagonal, and z' z."""
    return (d_low, own_low * (1 + 1e-12)), (own_high * (1 - 1e-12), d_high + float(np.linalg.eigvalsh(cross)[-1]) * (1 + 1e-9) + 1e-300)


def judged(low: tuple[float, float], high: tuple[float, float], worst: float = WORST) -> bool | None:
    """Whether the matrix is badly conditioned; None if the intervals don't tell yet."""
    if low[1] <= TINY or high[0] > worst * low[1]:
        return True
    return False if low[0] > TINY and high[1] <= worst * low[0] else None


def _settled(low, high, worst: float) -> bool:
    return judged(low, high, worst) is not None or (low[1] - low[0] <= 1e-12 * low[1] and high[1] - high[0] <= 1e-12 * high[1])


def ends(x: np.ndarray, fm: np.ndarray, d: np.ndarray, done: Callable[..., bool] | None = None) -> tuple[tuple[float, float], tuple[float, float]]:
    """Intervals of the least and largest eigenvalue of x fm x' + diag(d). No matrix of stocks by stocks is made."""
    return spread(x @ root(fm), d, done)


def spread(z: np.ndarray, d: np.ndarray, done: Callable[..., bool] | None = None) -> tuple[tuple[float, float], tuple[float, float]]:
    """The same of z z' + diag(d)."""
    own = d + (z * z).sum(1)
    done = done or (lambda low, high: low[1] - low[0] <= 1e-10 * low[1] and high[1] - high[0] <= 1e-10 * high[1])
    return bracketed(lambda at: counted(*pivots(z, d, at)), len(d), *_bounds(d.min(), d.max(), own.min(), own.max(), z.T @ z), done)


def badly_conditioned(rows: DataFrame, fm: np.ndarray, worst: float = WORST) -> bool:
    """Of x fm x' + diag(var), rows: x, var. Each step is an aggregate of one number for
    every two factors (and point) over stocks; that many come to the driver."""
    g = root(fm)

    def summed(at: np.ndarray | None) -> dict[tuple[int, int, int], float]:
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, least, most = None, [], []
            for b in batches:
                z, d = np.vstack(b["x"].to_numpy()) @ g, b["var"].to_numpy(float)
                if at is None:
                    own = d + (z * z).sum(1)
                    add = np.array([len(d)]), (z.T @ z)[None]
                    least, most = [*least, (d.min(), own.min())], [*most, (d.max(), own.max())]
                else:
                    add = pivots(z, d, at)
                total = add if total is None else (total[0] + add[0], total[1] + add[1])
            if total is not None:
                p, i, j = np.indices(total[1].shape)
                yield pd.DataFrame({"p": p.ravel(), "i": i.ravel(), "j": j.ravel(), "s": total[1].ravel(), "low": np.nan, "high": np.nan})
                yield pd.DataFrame({"p": range(len(total[0])), "i": -1, "j": -1, "s": total[0].astype(float), "low": np.nan, "high": np.nan})
                if at is None:
                    for k in (0, 1):
                        yield pd.DataFrame({"p": [k], "i": -2, "j": -2, "s": 0.0, "low": min(v[k] for v in least), "high": max(v[k] for v in most)})

        found = rows.select("x", "var").mapInPandas(each, "p int, i int, j int, s double, low double, high double")
        return {(r.p, r.i, r.j): (r.s, r.low, r.high) for r in found.groupBy("p", "i", "j").agg(F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).collect()}

    def square_of(told: dict, p: int) -> np.ndarray:
        return np.array([[told[p, i, j][0] for j in range(len(g))] for i in range(len(g))])

    first = summed(None)
    if not first:
        return False
    n, (d, own) = int(first[0, -1, -1][0]), (first[0, -2, -2], first[1, -2, -2])

    def count(at: np.ndarray) -> np.ndarray:
        told = summed(at)
        return counted(np.array([told[p, -1, -1][0] for p in range(len(at))]), np.array([square_of(told, p) for p in range(len(at))]))

    low, high = bracketed(count, n, *_bounds(d[1], d[2], own[1], own[2], square_of(first, 0)), lambda a, b: _settled(a, b, worst))
    return judged(low, high, worst) is not False


def covariance_matrix(model: Model, k: int, stocks: list | None = None, h: int = 1, worst: float = WORST, share: float = SHARE) -> DataFrame:
    """stock_i, stock_j, cov over h dates, for all stocks or those named. k: number of
    factors. Without any return it is the identity.

    Stocks are dealt into blocks, and pairs of blocks are multiplied out each by
    itself. A badly conditioned matrix is drawn to its diagonal.
    """
    fm = square(model.fcov, k)
    rows = (model.x if stocks is None else model.x.where(F.col("stock").isin(stocks))).join(model.spec, "stock", "left")
    kind = dict(rows.dtypes)["stock"]
    one = rows.join(F.broadcast(rows.agg(F.count("*").alias("_n")))).select("stock", "x", F.coalesce("var", F.lit(1e-6)).alias("var"), F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"))
    if fm is None:
        one = one.withColumns({"x": F.array_repeat(F.lit(0.0), k), "var": F.lit(1.0)})
        fm, h = np.zeros((k, k)), 1
    one = written(one)
    drawn = badly_conditioned(one, fm, worst)
    held = one.withColumn("_own", F.pmod(F.xxhash64("stock"), F.col("_blocks")).cast("int")).groupBy("_own").agg(F.collect_list(F.struct("stock", "x", "var")).alias("c"), F.max("_blocks").alias("_blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    left = held.select(F.col("_own").alias("i"), other.alias("j"), F.col("c").alias("a"))
    right = held.select(F.col("_own").alias("j"), other.alias("i"), F.col("c").alias("b"))
    pairs = left.join(right, ["i", "j"]).select("a", "b")

    def multiplied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in zip(batch["a"], batch["b"], strict=True):
                xa, xb = (np.vstack([q["x"] for q in c]) for c in (a, b))
                na, nb = (np.array([q["stock"] for q in c], object) for c in (a, b))
                v = xa @ fm @ xb.T
                same = (na[:, None] == nb[None, :]).astype(bool)
                v = (v + same * np.array([q["var"] for q in a])[:, None]) * h
                if drawn:
                    v = np.where(same, v, (1 - share) * v)
                yield pd.DataFrame({"stock_i": np.repeat(na, len(nb)), "stock_j": np.tile(nb, len(na)), "cov": v.ravel()})

    return pairs.mapInPandas(multiplied, f"stock_i {kind}, stock_j {kind}, cov double")
