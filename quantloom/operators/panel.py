"""Shape of panels: long frames of one row a date (ts) and stock."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.session import written

KEY = ("ts", "stock")
#: Attributes of bars in their usual order; other attributes follow by name.
BAR = ("open", "high", "low", "close", "volume", "vwap")


def require(df: DataFrame, *names: str) -> DataFrame:
    """df, if it has these columns."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def values(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in KEY]


def ordered(df: DataFrame) -> DataFrame:
    """df with its columns in the usual order: the keys, then bars' attributes (or,
    if there are others, all by name). Rows of a table have no order of their own."""
    names = values(df)
    inside = [c for c in BAR if c in names] if set(names) <= set(BAR) else sorted(names)
    return df.select(*[k for k in KEY if k in df.columns], *inside)


def known_attributes(frames: list[DataFrame], known: tuple[str, ...], keys: tuple[str, ...] = KEY) -> DataFrame:
    """Rows of all frames, matched by name, with the keys and those of the known
    attributes that any of them has."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return both.select(*keys, *[c for c in known if c in both.columns and c not in keys])


def common_stocks(df: DataFrame, names: list[str], splits: tuple[str, ...] = ("train", "cv", "test")) -> DataFrame:
    """stock: those that have a value of some of these columns in every split. df: with split."""
    some = reduce(Column.__or__, [F.col(c).isNotNull() for c in names])
    return reduce(DataFrame.intersect, [df.where(some & (F.col("split") == s)).select("stock") for s in splits])


def numbered(df: DataFrame, by: str, name: str = "place") -> DataFrame:
    """df (one row a value of `by`) with its place in order, from 1. Rows are dealt
    out by ranges and numbered within; one count a range comes to the driver."""
    ranged = written(df.repartitionByRange(by).withColumn("_part", F.spark_partition_id()))
    before, total = [F.lit(-1), F.lit(0)], 0
    for part, n in sorted(ranged.groupBy("_part").count().collect()):
        before += [F.lit(part), F.lit(total)]
        total += n
    place = F.row_number().over(Window.partitionBy("_part").orderBy(by)) + F.element_at(F.create_map(*before), F.col("_part"))
    return ranged.withColumn(name, place).drop("_part")


def densify(df: DataFrame) -> DataFrame:
    """A row for each date and stock of df; cells that weren't there are null.

    Dates are few (a century of days is 37 thousand), so they are broadcast to
    the stocks; the result is as large as a dense panel is.
    """
    return _by_dates(df, df)


def _by_dates(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """df on each date of calendar. The names of stocks are few rows before they meet
    the dates and very many after, so their number of partitions is given: it would
    be chosen by the few rows, and all that follows by stock would be in one task."""
    parts = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many as usual would be taken for the exchange of distinct()
    stocks = df.select("stock").distinct().repartition(parts, "stock")
    return stocks.join(F.broadcast(calendar.select("ts").distinct())).join(df, list(KEY), "left").select(df.columns)


def reindexed(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """df on the dates of calendar (ts), for each of its stocks."""
    return _by_dates(df, calendar)


def calendar_days(df: DataFrame) -> DataFrame:
    """ts: every day from the first to the last of df."""
    ends = df.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias("ts"))


def numbered_dates(df: DataFrame) -> DataFrame:
    """ts, rn (from 0), n: the dates of df. A single window over dates, which are few."""
    whole = Window.orderBy("ts")
    return df.select("ts").distinct().select("ts", (F.row_number().over(whole) - 1).alias("rn"), F.count("*").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))


def split_dates(df: DataFrame, train: float = 0.7, cv: float = 0.15, test: float = 0.15) -> DataFrame:
    """df with split (train, cv or test): shares of its dates, in order."""
    if abs(train + cv + test - 1) > 1e-9:
        raise ValueError("the shares must add up to 1")
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * (train + cv))
    d = numbered_dates(df).select("ts", F.when(F.col("rn") < a, "train").when(F.col("rn") < b, "cv").otherwise("test").alias("split"))
    return df.join(F.broadcast(d), "ts").select(*df.columns, "split")


def every(df: DataFrame, n: int) -> DataFrame:
    """The rows of every n-th date, the first included."""
    if n < 1:
        raise ValueError("n must be positive")
    return df.join(F.broadcast(numbered_dates(df).where(F.col("rn") % n == 0).select("ts")), "ts", "left_semi")


def slice_stock(df: DataFrame, stock) -> DataFrame:
    return df.where(F.col("stock") == F.lit(stock))


def unpivoted(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """ts, stock, attribute, value."""
    return df.unpivot(list(KEY), names or values(df), "attribute", "value")


def pivoted(long: DataFrame, names: list[str]) -> DataFrame:
    """unpivoted() undone: ts, stock and a column for each attribute named."""
    return long.groupBy(*KEY).pivot("attribute", names).agg(F.first("value")).select(*KEY, *names)


def by_stock(df: DataFrame, value: str, stocks: list) -> DataFrame:
    """For export: ts and a column of `value` for each of the stocks named."""
    wide = df.where(F.col("stock").isin(stocks)).groupBy("ts").pivot("stock", stocks).agg(F.first(value))
    return wide.select("ts", *[F.col(f"`{s}`") for s in stocks])


def filled_dates(df: DataFrame) -> DataFrame:
    """df without the dates on which no stock has any value."""
    some = reduce(Column.__or__, [F.col(c).isNotNull() for c in values(df)])
    return df.join(df.where(some).select("ts").distinct(), "ts", "left_semi").select(df.columns)


def incomplete_dates(df: DataFrame) -> DataFrame:
    """ts, n_null, n: dates on which some but not all cells are null."""
    null = sum((F.col(c).isNull().cast("long") for c in values(df)), F.lit(0))
    sums = df.groupBy("ts").agg(F.sum(null).alias("n_null"), (F.count("*") * len(values(df))).alias("n"))
    return sums.where("n_null > 0 and n_null < n")


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; a date that new has is taken from new as a whole. Columns are matched by name."""
    kept = old.join(new.select("ts").distinct(), "ts", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def new_dates(wanted: DataFrame, have: DataFrame) -> DataFrame:
    return wanted.select("ts").distinct().join(have.select("ts").distinct(), "ts", "left_anti")


def exploded_last(df: DataFrame, tickers: str, seq: str, strict: bool = False) -> DataFrame:
    """One row per ts and ticker of a list column: for each column its last value
    by seq that isn't null (strict: the last row's, null or not)."""
    rest = [c for c in df.columns if c not in ("ts", tickers, seq)]
    each = df.select("ts", F.explode(tickers).alias("stock"), seq, *rest)
    last = lambda c: F.max_by(c, seq) if strict else F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq)))
    return each.groupBy(*KEY).agg(*[last(c).alias(c) for c in rest])


def asof(calendar: DataFrame, side: DataFrame, value: str) -> DataFrame:
    """calendar's dates with side's last value up to that date; dates before the first get the first.

    Both are series by date, so one window over dates serves.
    """
    dates = calendar.select("ts").distinct().withColumn("_want", F.lit(True))
    both = dates.join(side.select("ts", value), "ts", "full")
    order = Window.orderBy("ts")
    before = F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return both.withColumn(value, F.coalesce(before, after)).where("_want").select("ts", value)


def first_usable_date(df: DataFrame, names: list[str], least: float = 0.5) -> DataFrame:
    """ts: the first date on which at least that share of stocks has one of these columns."""
    some = reduce(Column.__or__, [F.col(c).isNotNull() for c in names])
    share = df.groupBy("ts").agg(F.avg(some.cast("double")).alias("share"))
    return share.where(F.col("share") >= least).agg(F.min("ts").alias("ts"))


def estimated_cap(df: DataFrame, latest: str = "cap_latest", price: str = "close") -> DataFrame:
    """df with est_cap: price times the ratio of the latest capitalisation to the price on the last date."""
    end = df.select("ts").agg(F.max("ts").alias("_end"))
    last = df.join(F.broadcast(end), F.col("ts") == F.col("_end")).select(F.col("stock").alias("_s"), F.try_divide(F.col(latest), F.col(price)).alias("_ratio"))
    return df.join(last, F.col("stock") == F.col("_s"), "left").withColumn("est_cap", F.col(price) * F.col("_ratio")).drop("_s", "_ratio")
