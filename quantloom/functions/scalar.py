"""Functions of one cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column, b: Column) -> Column:
    """a / b; null for a zero or null divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clean(x: Column | str) -> Column:
    """x as a double; NaN and infinities are null."""
    d = col(x).cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def if_else(condition: Column, a: Column | float, b: Column | float) -> Column:
    """a or b; null where the condition is null."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(condition, as_col(a)).when(~condition, as_col(b))


def ones() -> Column:
    return F.lit(1.0)


def zeros() -> Column:
    return F.lit(0.0)


def clip(x: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """x within bounds; null stays null, a null bound doesn't bind."""
    out = x
    if low is not None:
        out = F.greatest(out, low)
    if high is not None:
        out = F.least(out, high)
    return F.when(x.isNotNull(), out)


def indicator(condition: Column) -> Column:
    """1.0 where it holds, else (null too) 0.0."""
    return F.coalesce(condition.cast("double"), F.lit(0.0))


def cap(price: str = "close", shares: str = "diluted_shares_outstanding") -> Column:
    return F.col(price) * F.col(shares)


def enterprise_value() -> Column:
    return cap() + F.col("total_liabilities") - F.col("cash_and_equivalents")


#: Divisions of the Standard Industrial Classification by major group (first two digits): fixed values.
DIVISIONS = (
    (1, 9, "A"),
    (10, 14, "B"),
    (15, 17, "C"),
    (20, 39, "D"),
    (40, 49, "E"),
    (50, 51, "F"),
    (52, 59, "G"),
    (60, 67, "H"),
    (70, 89, "I"),
    (91, 99, "J"),
)


def sic_division(sic: Column | str) -> Column:
    """A to J; null outside of all divisions."""
    major = F.floor(col(sic) / 100)
    out = F.lit(None).cast("string")
    for low, high, name in DIVISIONS:
        out = F.when(major.between(low, high), name).otherwise(out)
    return out
