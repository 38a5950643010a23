"""Backtests of weights: preparation, trading with costs, and metrics."""

from __future__ import annotations

import bisect
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quantloom.functions.ts import ffill, forward_return, ts_delay
from quantloom.operators.panel import KEY, numbered, require

DAYS = 252


def by_date():
    return Window.partitionBy("ts")


def so_far():
    """Over dates, one row each, up to the current one."""
    return Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)


@dataclass(frozen=True)
class Config:
    """Costs and limits. tiers: (stocks up to this place, basis points), in order; beyond: those of places after the
    last. unit_sum: a date's weights are scaled to 1, and a total within sum_tolerance of 0 is an error."""

    capital: float = 1_000_000.0
    holding_period: int = 1
    commission: float = 0.005
    least_commission: float = 1.0
    tiers: tuple[tuple[int, float], ...] = ((500, 13.0), (1500, 20.0), (3000, 50.0))
    beyond: float = 50.0
    borrow: float = 0.01
    least_trade: float = 0.0005
    least_notional: float = 0.0
    unit_sum: bool = True
    sum_tolerance: float = 1e-6


def hold(weights: DataFrame, holding_period: int) -> DataFrame:
    """On dates on which no stock has a weight, each stock takes its own last one of
    up to holding_period - 1 dates before (also one that the last date with weights
    left out). Other dates stay as they are."""
    some = F.max(F.col("weight").isNotNull()).over(by_date())
    marked = weights.withColumn("_held", ffill("weight", holding_period - 1)).withColumn("_some", some)
    return marked.select(*KEY, F.when(F.col("_some"), F.col("weight")).otherwise(F.col("_held")).alias("weight"))


def prepared(weights: DataFrame, holding_period: int = 1, unit_sum: bool = True, tolerance: float = Config.sum_tolerance) -> DataFrame:
    """Weights held, each date's scaled to add up to 1 (unless not unit_sum), nulls as 0.

    A date whose weights add up to less than the tolerance, either way, though some aren't null raises an error.
    """
    w = hold(weights, holding_period)
    if not unit_sum:
        return w.select(*KEY, F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = F.sum("weight").over(by_date())
    some = F.max(F.col("weight").isNotNull()).over(by_date())
    bad = F.assert_true(~some | (F.abs(total) >= tolerance), F.lit("a date's weights add up to 0"))
    scaled = w.withColumn("_ok", bad).withColumn("weight", F.coalesce(F.try_divide(F.col("weight"), total), F.lit(0.0)))
    return scaled.where("_ok is null").select(*KEY, "weight")


def totals(weights: DataFrame, holding_period: int = 1, tolerance: float = Config.sum_tolerance) -> DataFrame:
    """ts, total, state of the dates with weights: whether they add up to 1 (one), to more
    (over) or less (under), or to nothing, which prepared() refuses (zero)."""
    t = hold(weights, holding_period).groupBy("ts").agg(F.sum("weight").alias("total")).where("total is not null")
    state = F.when(F.abs("total") < tolerance, "zero").when(F.col("total") < 1 - tolerance, "under").when(F.col("total") > 1 + tolerance, "over").otherwise("one")
    return t.withColumn("state", state)


def warned(weights: DataFrame, holding_period: int = 1, tolerance: float = Config.sum_tolerance) -> int:
    """The number of dates whose weights add up to less than 1, of which a warning tells."""
    under = totals(weights, holding_period, tolerance).where("state = 'under'").agg(F.count("*").alias("n"), F.min("ts").alias("first")).first()
    if under.n:
        warnings.warn(f"weights of {under.n} dates add up to less than 1 and are scaled, first {under.first}", RuntimeWarning, stacklevel=2)
    return under.n


def slippage(stocks: DataFrame, tiers: tuple[tuple[int, float], ...] = Config.tiers, beyond: float = Config.beyond) -> DataFrame:
    """stock, place (from 1, by name), bps."""
    place = numbered(stocks.select("stock").distinct(), "stock")
    bps = F.lit(beyond)
    for most, b in reversed(tiers):
        bps = F.when(F.col("place") <= most, b).otherwise(bps)
    return place.withColumn("bps", bps)


def gated(weights: DataFrame, least: float) -> DataFrame:
    """weights (prepared) with traded: the weight held after trades of less than `least`
    are left out. A stock's dates stream through a fold that keeps one number."""
    if least <= 0:
        return weights.withColumn("traded", F.col("weight"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stock, now = None, 0.0
        for b in batches:
            out = []
            for s, w in zip(b.column("stock").to_pylist(), b.column("weight").to_pylist(), strict=True):
                if s != stock:
                    stock, now = s, 0.0
                if abs(w - now) >= least:
                    now = w
                out.append(now)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, "traded"])

    rows = weights.select(*KEY, "weight").repartition("stock").sortWithinPartitions("stock", "ts")
    return rows.mapInArrow(fold, StructType([*rows.schema.fields, StructField("traded", DoubleType())]))


def trades(panel: DataFrame, weights: DataFrame, least: float = 0.0, tiers: tuple[tuple[int, float], ...] = Config.tiers, beyond: float = Config.beyond) -> DataFrame:
    """ts, stock, w, dw, ret (ahead), price, bps on dates with any return ahead. panel: dense, with close."""
    ahead = panel.select(*KEY, F.col("close").alias("price"), forward_return("close").alias("ret"))
    ahead = ahead.withColumn("_any", F.max(F.col("ret").isNotNull()).over(by_date())).where("_any").drop("_any")
    w = gated(prepared_on(weights, ahead), least)
    both = ahead.join(w, list(KEY), "left").withColumn("w", F.coalesce("traded", F.lit(0.0)))
    both = both.withColumn("dw", F.col("w") - F.coalesce(ts_delay("w", 1), F.lit(0.0)))
    return both.join(slippage(panel, tiers, beyond), "stock").select(*KEY, "w", "dw", "ret", "price", "bps")


def prepared_on(weights: DataFrame, days: DataFrame) -> DataFrame:
    return days.select(*KEY).join(weights, list(KEY), "left").select(*KEY, F.coalesce("weight", F.lit(0.0)).alias("weight"))


def daily(t: DataFrame) -> DataFrame:
    """ts, gross, turnover, slip (cost as a share of equity), short, lots (traded shares of
    equity by price, sorted) and above (for each lot the sum of it and all larger ones, and at the end 0)."""
    lot = F.when((F.abs("dw") > 0) & (F.col("price") > 0), F.abs("dw") / F.col("price"))
    d = t.groupBy("ts").agg(
        F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("gross"),
        F.sum(F.abs("dw")).alias("turnover"),
        F.sum(F.abs("dw") * F.col("bps") / 1e4).alias("slip"),
        F.sum(F.abs(F.least(F.col("w"), F.lit(0.0)))).alias("short"),
        F.array_sort(F.collect_list(lot)).alias("lots"),
    )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            above = [np.append(np.cumsum(np.asarray(x.as_py())[::-1])[::-1], 0.0) if len(x) else np.zeros(1) for x in b.column("lots")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(above, pa.list_(pa.float64()))], [*b.schema.names, "above"])

    return d.mapInArrow(summed, StructType([*d.schema.fields, StructField("above", ArrayType(DoubleType()))]))


def run(panel: DataFrame, weights: DataFrame, config: Config = Config()) -> DataFrame:
    """ts, gross, net, turnover, cost, equity (before the date's return).

    weights: ts, stock, weight, prepared here. Commissions have a least charge
    for each trade, so each date's cost depends on the equity before it: dates
    are folded in order, as a stream of one row a date. Its trades are sorted and
    summed before, so that the fold finds by search which of them pay the least
    charge. The fold keeps one number; with least_notional, which leaves out trades by their worth in
    money, it keeps the weight of each stock too, and each date's row holds its
    stocks, for no date can be traded before the one before it.
    """
    require(panel, *KEY, "close")
    w = prepared(weights, config.holding_period, config.unit_sum, config.sum_tolerance)
    if config.least_notional > 0:
        t = trades(panel, w, 0.0, config.tiers, config.beyond)
        cell = F.struct("stock", "w", F.coalesce("ret", F.lit(0.0)).alias("ret"), "price", "bps")
        d = t.groupBy("ts").agg(F.collect_list(cell).alias("cells"))
    else:
        d = daily(trades(panel, w, config.least_trade, config.tiers, config.beyond))
    schema = pa.schema([("ts", pa.date32()), *((n, pa.float64()) for n in ("gross", "net", "turnover", "cost", "equity"))])

    def day(cells: list[dict], held: dict, equity: float) -> dict:
        """What daily() gives, after the trades that are worth it."""
        out = {"gross": 0.0, "turnover": 0.0, "slip": 0.0, "short": 0.0, "lots": []}
        for c in cells:
            now = held.get(c["stock"], 0.0)
            change = abs(c["w"] - now)
            if change >= config.least_trade and change * equity >= config.least_notional:
                held[c["stock"]] = now = c["w"]
                out["turnover"] += change
                out["slip"] += change * c["bps"] / 1e4
                if change > 0 and (c["price"] or 0) > 0:
                    out["lots"].append(change / c["price"])
            out["gross"] += now * c["ret"]
            out["short"] += max(0.0, -now)
        out["lots"].sort()
        out["above"] = np.append(np.cumsum(out["lots"][::-1])[::-1], 0.0)
        return out

    def charged(lots: list[float], above: list[float], equity: float) -> float:
        """Commissions: lots are sorted, so those that pay the least charge come first."""
        rate = equity * config.commission
        few = bisect.bisect_left(lots, config.least_commission / rate) if rate > 0 else len(lots)
        return few * config.least_commission + float(above[few]) * rate if lots else 0.0

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        equity, held = config.capital, {}
        for b in batches:
            out = []
            for r in b.to_pylist():
                if "cells" in r:
                    r |= day(r["cells"], held, equity)
                fee = charged(r["lots"], r["above"], equity)
                cost = fee + (r["slip"] + r["short"] * config.borrow / DAYS) * equity
                net = r["gross"] - (cost / equity if equity > 0 else 0.0)
                out.append({"ts": r["ts"], "gross": r["gross"], "net": net, "turnover": r["turnover"], "cost": cost, "equity": equity})
                equity *= 1 + net
            yield pa.RecordBatch.from_pylist(out, schema)

    # an exchange, so that dates are put together in many tasks and only their rows pass through the fold
    ordered = d.repartition(1).sortWithinPartitions("ts")
    return ordered.mapInArrow(fold, "ts date, gross double, net double, turnover double, cost double, equity double")


def equity_curve(returns: DataFrame, r: str = "net") -> DataFrame:
    """ts, r, equity (from 1), peak, drawdown."""
    df = returns.withColumn("equity", F.product(1 + F.col(r)).over(so_far())).withColumn("peak", F.max("equity").over(so_far()))
    return df.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) > 1e-15, a / b)


def metrics(returns: DataFrame) -> DataFrame:
    """One row: total_return, annual_return, annual_gross, cost_drag, volatility,
    sharpe, sortino, max_drawdown, ulcer, upi, avg_turnover, n. returns: ts, gross, net, turnover."""
    m = equity_curve(returns, "net").agg(
        (F.product(1 + F.col("net")) - 1).alias("total_return"),
        (F.avg("net") * DAYS).alias("annual_return"),
        (F.avg("gross") * DAYS).alias("annual_gross"),
        (F.stddev_samp("net") * DAYS**0.5).alias("volatility"),
        (F.stddev_samp(F.when(F.col("net") < 0, F.col("net"))) * DAYS**0.5).alias("_down"),
        F.min("drawdown").alias("max_drawdown"),
        F.sqrt(F.avg(F.col("drawdown") * F.col("drawdown"))).alias("ulcer"),
        F.avg("turnover").alias("avg_turnover"),
        F.count("*").alias("n"),
    )
    a = F.col("annual_return")
    new = {"cost_drag": F.col("annual_gross") - a, "sharpe": _ratio(a, F.col("volatility")), "sortino": _ratio(a, F.col("_down")), "upi": _ratio(a, F.col("ulcer"))}
    return m.withColumns(new).drop("_down")


def benchmark_metrics(returns: DataFrame, bench: DataFrame) -> DataFrame:
    """One row: beta, alpha, tracking_error, benchmark_total, benchmark_annual,
    active_return, information_ratio. bench: ts, close, one for each date of returns."""
    b = bench.withColumn("b", F.try_divide(F.col("close"), F.lag("close").over(Window.orderBy("ts"))) - 1)
    both = returns.select("ts", "net").join(b.select("ts", "b"), "ts").where("b is not null")
    m = both.agg(
        F.covar_samp("net", "b").alias("_cov"),
        F.var_samp("b").alias("_var"),
        (F.stddev_samp(F.col("net") - F.col("b")) * DAYS**0.5).alias("tracking_error"),
        (F.product(1 + F.col("b")) - 1).alias("benchmark_total"),
        F.count("*").alias("_n"),
        (F.avg("net") * DAYS).alias("_annual"),
    )
    m = m.withColumn("benchmark_annual", F.pow(1 + F.col("benchmark_total"), DAYS / F.col("_n")) - 1).withColumn("beta", _ratio(F.col("_cov"), F.col("_var")))
    m = m.withColumn("active_return", F.col("_annual") - F.col("benchmark_annual"))
    return m.select("beta", (F.col("_annual") - F.col("beta") * F.col("benchmark_annual")).alias("alpha"), "tracking_error", "benchmark_total", "benchmark_annual", "active_return", _ratio(F.col("active_return"), F.col("tracking_error")).alias("information_ratio"))


def report(curve: DataFrame) -> DataFrame:
    """One row: annual_geometric, report_volatility, report_sharpe, report_max_dd of an
    equity curve (ts, equity, drawdown): returns from its second date on."""
    r = curve.withColumn("_r", F.try_divide(F.col("equity"), F.lag("equity").over(Window.orderBy("ts"))) - 1)
    m = r.agg(
        F.try_divide(F.max_by("equity", "ts"), F.min_by("equity", "ts")).alias("_grown"),
        F.count("*").alias("_n"),
        (F.stddev_samp("_r") * DAYS**0.5).alias("report_volatility"),
        F.min("drawdown").alias("report_max_dd"),
    )
    m = m.withColumn("annual_geometric", F.pow("_grown", DAYS / F.col("_n")) - 1)
    return m.select("annual_geometric", "report_volatility", _ratio(F.col("annual_geometric"), F.col("report_volatility")).alias("report_sharpe"), "report_max_dd")


def plotted(curve: DataFrame, bench: DataFrame) -> DataFrame:
    """ts, equity, drawdown, turnover, benchmark (scaled to 1 on the first date): what a chart shows."""
    both = curve.join(bench, "ts", "left")
    first = F.first("close", ignorenulls=True).over(Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return both.select("ts", "equity", "drawdown", "turnover", F.try_divide(F.col("close"), first).alias("benchmark"))

