"""Cleaning of panels: sparse stocks, other securities, the investable universe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.panel import KEY, values


def without_sparse(df: DataFrame, most_null: float = 0.5, names: list[str] | None = None) -> DataFrame:
    """The stocks whose share of null cells, over dates and columns, is at most most_null."""
    names = names or values(df)
    null = sum((F.col(c).isNull().cast("long") for c in names), F.lit(0))
    kept = df.groupBy("stock").agg((F.sum(null) / (F.count("*") * len(names))).alias("share")).where(F.col("share") <= most_null)
    return df.join(kept.select("stock"), "stock", "left_semi").select(df.columns)


def of_type(df: DataFrame, reference: DataFrame, kind: str = "CS") -> DataFrame:
    """The stocks that reference (stock, type) lists with that type."""
    return df.join(reference.where(F.col("type") == kind).select("stock").distinct(), "stock", "left_semi").select(df.columns)


def in_universe(df: DataFrame, n: int = 3000, by: str = "volume", company: str | None = None) -> DataFrame:
    """df with in_universe: whether the stock is among the n largest of its date
    (ties share the best rank). With a company column, companies are ranked by
    their stocks' sum; stocks without a company are always in, those without a
    value take their company's rank."""
    by = by if by in df.columns else "volume"
    if company is None:
        place = F.rank().over(Window.partitionBy("ts").orderBy(F.desc_nulls_last(by)))
        return df.withColumn("in_universe", F.when(F.col(by).isNull(), True).otherwise(place <= n))
    total = df.where(F.col(by).isNotNull() & F.col(company).isNotNull()).groupBy("ts", company).agg(F.sum(by).alias("_sum"))
    ranked = total.select("ts", company, F.rank().over(Window.partitionBy("ts").orderBy(F.desc("_sum"))).alias("_place"))
    return df.join(ranked, ["ts", company], "left").select(*df.columns, F.coalesce(F.col("_place") <= n, F.lit(True)).alias("in_universe"))


def masked(df: DataFrame, value: float = -1.0) -> DataFrame:
    """Every number of rows out of the universe replaced by value."""
    numbers = [c for c, t in df.dtypes if c not in KEY and t in ("double", "float", "int", "bigint")]
    return df.withColumns({c: F.when(F.col("in_universe"), F.col(c)).otherwise(F.lit(value).cast(dict(df.dtypes)[c])) for c in numbers})


def cleaned(df: DataFrame, reference: DataFrame, most_null: float = 0.5, n: int = 3000, by: str = "volume", company: str | None = None) -> DataFrame:
    """Sparse stocks out, other securities out, then the universe masked."""
    return masked(in_universe(of_type(without_sparse(df, most_null), reference), n, by, company))
