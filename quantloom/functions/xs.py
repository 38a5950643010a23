"""Cross-sectional functions: over the stocks of one date."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quantloom.functions.scalar import clip, col, ratio


def by_date():
    return Window.partitionBy("ts")


#: Standard deviations up to this are rounding noise of constant values.
NOISE = 1e-12


def rank(x: Column | str, digits: int | None = None) -> Column:
    """Average rank over the number of values, in (0, 1]. With digits, values that
    agree when rounded to so many places are ties."""
    x = col(x) if digits is None else F.round(col(x), digits)
    order = by_date().orderBy(x.asc_nulls_last())
    place = F.rank().over(order)
    ties = F.count(x).over(order.rangeBetween(Window.currentRow, Window.currentRow))  # the row's equals: one sort serves both
    return F.when(x.isNotNull(), ratio(place + (ties - 1) / 2, F.count(x).over(by_date())))


def zscore(x: Column | str) -> Column:
    """Null where all values of a date are equal."""
    sd = F.stddev_samp(col(x)).over(by_date())
    return ratio(col(x) - F.avg(col(x)).over(by_date()), F.when(sd > NOISE, sd))


def neutralize(x: Column | str, group: Column | str | None = None) -> Column:
    """x less the mean of its date, or of its date and group; x itself where the group is null."""
    if group is None:
        return col(x) - F.avg(col(x)).over(by_date())
    return F.when(col(group).isNotNull(), col(x) - F.avg(col(x)).over(Window.partitionBy("ts", col(group)))).otherwise(col(x))


def winsorize(x: Column | str, low: float = 0.01, high: float = 0.99) -> Column:
    """x within the date's quantiles (linear between values)."""
    at = lambda q: F.percentile(col(x), q).over(by_date())
    return clip(col(x), at(low), at(high))
