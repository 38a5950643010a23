"""Predictive power of factors: information coefficients and their ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import xs
from quantloom.functions.ts import forward_return

NOISE = 1e-12


def correlation(x: str, y: str) -> Column:
    """Pearson's, over complete pairs; null for fewer than two, or if either is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((F.count(a) >= 2) & (sa > NOISE) & (sb > NOISE), F.try_divide(F.covar_pop(a, b), sa * sb))


def with_forward(df: DataFrame, h: int = 1, name: str = "fwd") -> DataFrame:
    if h < 1:
        raise ValueError("the holding period must be positive")
    return df.withColumn(name, forward_return("close", h))


def _correlated(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ic, rank_ic, n of pairs (keys, value, fwd): both ranks are taken within a key."""
    keyed = pairs.where("value is not null and fwd is not null").select(F.struct(*keys).alias("ts"), "value", "fwd")
    ranked = keyed.withColumns({"_r": xs.rank("value", 9), "_f": xs.rank("fwd", 9)})
    out = ranked.groupBy("ts").agg(correlation("value", "fwd").alias("ic"), correlation("_r", "_f").alias("rank_ic"), F.count("*").alias("n"))
    return out.select("ts.*", "ic", "rank_ic", "n")


def coefficients(df: DataFrame, factors: list[str], fwd: str = "fwd") -> DataFrame:
    """ts, factor, ic, rank_ic, n: correlation of each factor with the return ahead, per date."""
    long = df.select("ts", F.col(fwd).alias("fwd"), *factors).unpivot(["ts", "fwd"], factors, "factor", "value")
    return _correlated(long, ["ts", "factor"])


def summary(ic: DataFrame, *by: str) -> DataFrame:
    """factor, ic_mean, ic_sd, icir, rank_ic_mean, rank_icir, n_dates (for each value of the columns `by`)."""
    of = lambda c, name: [F.avg(c).alias(f"{name}_mean"), F.stddev_samp(c).alias(f"{name}_sd")]
    s = ic.groupBy("factor", *by).agg(*of("ic", "ic"), *of("rank_ic", "rank_ic"), F.count("ic").alias("n_dates"))
    ir = lambda name: F.try_divide(F.col(f"{name}_mean"), F.when(F.col(f"{name}_sd") > NOISE, F.col(f"{name}_sd")))
    return s.select("factor", *by, "ic_mean", "ic_sd", ir("ic").alias("icir"), "rank_ic_mean", ir("rank_ic").alias("rank_icir"), "n_dates").orderBy(F.abs("icir").desc_nulls_last())


def across_intervals(df: DataFrame, factors: list[str], intervals: tuple[int, ...] = (1, 5, 10, 30)) -> DataFrame:
    """summary() with interval: returns of n rows ahead on every n-th date that has a factor or return.

    All returns come from one window; which dates count is told by one row a date.
    """
    if min(intervals, default=1) < 1:
        raise ValueError("intervals must be positive")
    ahead = {n: f"_fwd{n}" for n in intervals}
    df = df.withColumns({c: forward_return("close", n) for n, c in ahead.items()}).select("ts", *factors, *ahead.values())
    some = reduce(Column.__or__, [F.col(c).isNotNull() for c in factors])
    dates = df.groupBy("ts").agg(*[F.max(some | F.col(c).isNotNull()).alias(c) for c in ahead.values()])
    so_far = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    turn = lambda n, c: F.when(F.col(c) & (F.pmod(F.count_if(F.col(c)).over(so_far) - 1, F.lit(n)) == 0), F.lit(n))
    kept = dates.select("ts", F.array_compact(F.array(*[turn(n, c) for n, c in ahead.items()])).alias("_kept"))
    cells = [F.struct(F.lit(n).alias("interval"), F.col(c).alias("fwd")) for n, c in ahead.items()]
    own = F.filter(F.array(*cells), lambda x: F.array_contains("_kept", x["interval"]))
    long = df.join(F.broadcast(kept.where(F.size("_kept") > 0)), "ts").select("ts", *factors, F.inline(own)).unpivot(["ts", "interval", "fwd"], factors, "factor", "value")
    return summary(_correlated(long, ["ts", "interval", "factor"]), "interval")


def coverage(df: DataFrame, factors: list[str]) -> DataFrame:
    """factor, coverage: share of cells that have a value."""
    return df.select(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in factors]).unpivot([], factors, "factor", "coverage")


def covered(df: DataFrame, factors: list[str], least: float = 0.5) -> list[str]:
    """The factors with at least that coverage, in order."""
    row = df.select(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in factors]).first()
    return [c for c in factors if (row[c] or 0) >= least]

