"""Files as market-data services give them, landed as JSON, read into long frames.

Fetching is left to whatever lands the files; a stream of them is in streaming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.scalar import clean
from quantloom.operators.panel import exploded_last

BAR = "ticker string, open double, high double, low double, close double, volume double, vwap double, timestamp long"
#: Attributes of financial statements that are kept.
STATEMENT = (
    "cash_and_equivalents",
    "total_assets",
    "total_liabilities",
    "total_equity",
    "dividends",
    "net_income",
    "ebitda",
    "operating_income",
    "diluted_earnings_per_share",
    "diluted_shares_outstanding",
)


def daily_bars(spark: SparkSession, path: str) -> DataFrame:
    """ts, stock, open, high, low, close, volume, vwap of bars with a time in
    milliseconds. Of several bars of a stock and day the latest stands."""
    raw = spark.read.schema(BAR).json(path).where("ticker is not null and timestamp is not null")
    names = ["open", "high", "low", "close", "volume", "vwap"]
    day = F.timestamp_millis("timestamp").cast("date")
    bars = raw.groupBy(day.alias("ts"), F.col("ticker").alias("stock")).agg(F.max_by(F.struct(*names), F.struct("timestamp", *names)).alias("b"))
    return bars.select("ts", "stock", *[clean(F.col(f"b.{c}")).alias(c) for c in names])


def statements(spark: SparkSession, path: str, timeframe: str = "annual", strict: bool = False) -> DataFrame:
    """ts (filing date), stock and the statement attributes, for one timeframe. A
    filing names several tickers; of several statements of a stock and day the
    last value of each attribute stands (strict: the last statement as a whole)."""
    kinds = "filing_date date, tickers array<string>, timeframe string, seq long, " + ", ".join(f"{c} double" for c in STATEMENT)
    raw = spark.read.schema(kinds).json(path).where(F.col("timeframe") == timeframe)
    return exploded_last(raw.select(F.col("filing_date").alias("ts"), "tickers", "seq", *STATEMENT), "tickers", "seq", strict)


def ticker_details(spark: SparkSession, path: str) -> DataFrame:
    """stock, type, market_cap (0 where it isn't told)."""
    raw = spark.read.schema("ticker string, type string, market_cap double").json(path)
    return raw.select(F.col("ticker").alias("stock"), "type", F.coalesce("market_cap", F.lit(0.0)).alias("market_cap"))
