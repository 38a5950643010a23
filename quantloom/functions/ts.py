"""Rolling functions over the rows of one stock in time order.

Each returns a Column over windows by stock. Windows count panel rows (dates),
so a panel is made dense first. A window function cannot hold another: name the
inner result in an earlier step. Windows that are not full give null. Each
window is gone through for each row; functions/expr.py has the same functions
for nested use and in time that doesn't grow with the window.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quantloom.functions.scalar import col, ratio


def by_stock():
    return Window.partitionBy("stock").orderBy("ts")


def rows(w: int):
    return by_stock().rowsBetween(-(w - 1), 0)


def full(x: Column | str, w: int, agg: Column) -> Column:
    """agg where all w values of the window are there, else null."""
    return F.when(F.count(col(x)).over(rows(w)) == w, agg)


def ts_delay(x: Column | str, w: int) -> Column:
    return F.lag(col(x), w).over(by_stock()) if w >= 0 else F.lead(col(x), -w).over(by_stock())


def ts_delta(x: Column | str, w: int) -> Column:
    return col(x) - ts_delay(x, w)


def daily_return(price: Column | str = "close", w: int = 1) -> Column:
    """price over its value w rows ago, less 1; for a negative w the row ahead."""
    return ratio(col(price), ts_delay(price, w)) - 1


def forward_return(price: Column | str = "close", h: int = 1) -> Column:
    """What a holding of h rows from here on returns."""
    return ratio(ts_delay(price, -h), col(price)) - 1


def log_return(price: Column | str = "close") -> Column:
    return F.ln(col(price)) - F.ln(ts_delay(price, 1))


def ts_mean(x: Column | str, w: int) -> Column:
    return full(x, w, F.avg(col(x)).over(rows(w)))


def ts_sum(x: Column | str, w: int, missing: float | None = 0.0) -> Column:
    """A window that is not full gives `missing`."""
    total = full(x, w, F.sum(col(x)).over(rows(w)))
    return total if missing is None else F.coalesce(total, F.lit(missing))


def ts_std(x: Column | str, w: int) -> Column:
    return full(x, w, F.stddev_samp(col(x)).over(rows(w)))


def ts_zscore(x: Column | str, w: int) -> Column:
    """Null where the window is constant."""
    sd = ts_std(x, w)
    return ratio(col(x) - ts_mean(x, w), F.when(sd > 1e-12, sd))


def ts_rank(x: Column | str, w: int) -> Column:
    """The share of the other values of the window that are smaller."""
    if w < 2:
        return F.lit(None).cast("double")
    held = F.collect_list(col(x)).over(rows(w))
    return full(x, w, F.size(F.filter(held, lambda v: v < col(x))) / F.lit(float(w - 1)))


def _weighted(x: Column | str, weights: list[float]) -> Column:
    held = F.collect_list(col(x)).over(rows(len(weights)))
    given = F.array(*[F.lit(float(v)) for v in weights])
    dot = F.aggregate(F.zip_with(held, given, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    return full(x, len(weights), dot)


def ts_ewm_sum(x: Column | str, w: int, halflife: float) -> Column:
    """Mean of the window with weights that halve every `halflife` rows back."""
    raw = [0.5 ** ((w - 1 - i) / halflife) for i in range(w)]
    return _weighted(x, [v / sum(raw) for v in raw])


def decay(x: Column | str, n: int, newest_first: bool = False) -> Column:
    """Linear weights over n rows: n for the oldest, 1 for the newest (or the other way)."""
    if n < 2:
        return col(x)
    weights = [2 * (i + 1 if newest_first else n - i) / (n * (n + 1)) for i in range(n)]
    return _weighted(x, weights)


def rsi(gain: Column | str, loss: Column | str, w: int = 14) -> Column:
    """Relative strength from w gains and losses (zeros where there is none);
    100 in a window without a loss, null in one without any change. The strict
    form takes gains and losses that are null where there is none: a full window
    of both can't be, so it is null everywhere."""
    g, s = ts_mean(gain, w), ts_mean(loss, w)
    return F.when(g + s > 0, 100 * g / (g + s))


def ffill(x: Column | str, limit: int | None = None) -> Column:
    """The last value, at most `limit` rows back."""
    start = Window.unboundedPreceding if limit is None else -limit
    return F.last(col(x), ignorenulls=True).over(by_stock().rowsBetween(start, 0))


def bfill(x: Column | str) -> Column:
    return F.first(col(x), ignorenulls=True).over(by_stock().rowsBetween(0, Window.unboundedFollowing))
