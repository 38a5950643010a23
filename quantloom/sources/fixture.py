"""Panels derived from order lines: one stock a supplier, one row a week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.ts import ffill
from quantloom.operators.panel import densify

PRICES = ("open", "high", "low", "close", "volume", "vwap")
SIC = (850, 1040, 1311, 1521, 2834, 3674, 4911, 5311, 6020, 7372, 1800)
#: The ranges of the public classification into 49 industries that hold these codes (1800 is in none).
INDUSTRY_RANGES = (
    ("Agric", 100, 999),
    ("Drugs", 2833, 2836),
    ("BldMt", 800, 899),
    ("Cnstr", 1520, 1529),
    ("Gold", 1040, 1049),
    ("Oil", 1310, 1319),
    ("Util", 4910, 4911),
    ("BusSv", 7370, 7372),
    ("Chips", 3670, 3679),
    ("Rtail", 5310, 5311),
    ("Banks", 6020, 6020),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def week(c: Column | str) -> Column:
    return F.date_trunc("week", c).cast("date")


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed bars: ts, stock, open, high, low, close, volume, vwap."""
    price, qty, paid = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), F.col("l_extendedprice")
    turn = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    lines = table(spark, sf_dir, "lineitem").withColumn("p", price)
    return lines.groupBy(week("l_shipdate").alias("ts"), F.col("l_suppkey").alias("stock")).agg(
        F.min_by("p", turn).alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", turn).alias("close"),
        F.sum(qty).alias("volume"),
        (F.sum(paid) / F.sum(qty)).alias("vwap"),
    )


def weekly_panel(spark: SparkSession, sf_dir: str, filled: bool = False) -> DataFrame:
    """Dense panel with fundamentals and classification; filled: prices and volume carried forward."""
    bars = densify(weekly_bars(spark, sf_dir))
    lines = table(spark, sf_dir, "lineitem")
    yearly = lines.groupBy(F.year("l_shipdate").alias("yr"), F.col("l_suppkey").alias("s")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("operating_income"))
    firm = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.abs("s_acctbal").alias("bal"))
    df = bars.join(yearly, (F.year("ts") == F.col("yr")) & (F.col("stock") == F.col("s")), "left").join(firm, F.col("stock") == F.col("k"), "left")
    stock, income = F.col("stock"), F.col("operating_income")
    sic = F.get(F.array(*[F.lit(v) for v in SIC]), F.pmod(stock, F.lit(12)).cast("int"))
    df = df.select(
        "ts",
        "stock",
        *PRICES,
        (1000 + F.pmod(stock * 7919, F.lit(5000))).cast("double").alias("diluted_shares_outstanding"),
        "operating_income",
        (income * 0.8).alias("ebitda"),
        (income / 1e4).alias("diluted_earnings_per_share"),
        (F.col("bal") * 100).alias("total_liabilities"),
        (F.col("bal") * 10).alias("cash_and_equivalents"),
        sic.alias("sic_code"),
        F.when(F.pmod(stock, F.lit(17)) != 0, F.floor(stock / 2)).alias("cik"),
        F.when(F.pmod(stock, F.lit(5)) == 0, "ETF").otherwise("CS").alias("sec_type"),
    )
    return df.withColumns({c: ffill(c) for c in PRICES}) if filled else df


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, close: mean order price a week."""
    return table(spark, sf_dir, "orders").groupBy(week("o_orderdate").alias("ts")).agg(F.avg("o_totalprice").alias("close"))


def risk_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, rf: mean tax rate a quarter."""
    return table(spark, sf_dir, "lineitem").groupBy(F.date_trunc("quarter", "l_shipdate").cast("date").alias("ts")).agg(F.avg("l_tax").alias("rf"))


def industry_ranges(spark: SparkSession) -> DataFrame:
    """low, high, industry, place."""
    return spark.createDataFrame([(low, high, name, i) for i, (name, low, high) in enumerate(INDUSTRY_RANGES)], "low int, high int, industry string, place int")


def staggered_weights(panel: DataFrame) -> DataFrame:
    """ts, stock, weight: shares of volume on every second date, null on others; a third of the stocks, each time others, has none."""
    day = panel.select("ts").distinct().withColumn("_n", F.row_number().over(Window.orderBy("ts")) - 1)
    share = F.try_divide(F.col("volume"), F.sum("volume").over(Window.partitionBy("ts")))
    on = (F.col("_n") % 2 == 0) & (F.pmod(F.col("stock") + F.floor(F.col("_n") / 2), F.lit(3)) != 0)
    return panel.join(F.broadcast(day), "ts").select("ts", "stock", F.when(on, share).alias("weight"))


def volume_weights(panel: DataFrame, every: int = 5) -> DataFrame:
    """ts, stock, weight: shares of volume on every n-th date, null on others."""
    day = panel.select("ts").distinct().withColumn("_n", F.row_number().over(Window.orderBy("ts")) - 1)
    share = F.try_divide(F.col("volume"), F.sum("volume").over(Window.partitionBy("ts")))
    return panel.join(F.broadcast(day), "ts").select("ts", "stock", F.when(F.col("_n") % every == 0, share).alias("weight"))
