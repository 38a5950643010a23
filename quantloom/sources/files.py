"""Panel files: long Parquet, wide CSV with two header rows, factor caches."""

from __future__ import annotations

import csv
import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quantloom.functions.scalar import clean
from quantloom.operators.panel import KEY, densify, values


#: A cell of a line and the comma after it; commas may be in quotes.
CELL = r'("(?:[^"]|"")*"|[^,]*)(?:,|$)'


def _cells(line: Column) -> Column:
    """The cells of a line, without quotes around them. Lines of plain numbers are just split."""
    quoted = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(CELL), F.lit(1))
    bare = F.transform(quoted, lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.char_length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.when(F.contains(line, F.lit('"')), F.slice(bare, 1, F.size(bare) - 1)).otherwise(F.split(line, ",", -1))


def read_wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """ts, stock and a column for each attribute, of a CSV whose first row names
    attributes and whose second row names stocks.

    Cells are found by their place in the line: the two header rows (all that
    comes to the driver) become one row that tells where each stock's cells
    are, and it is sent to all lines. The plan has an expression for each
    attribute, however many columns there are, and no exchange. Cells that
    aren't numbers are null, as are NaN, infinities and those a line lacks; rows
    whose first cell is no date are left out. Of columns named alike the first counts.
    """
    lines = spark.read.text(path)
    head = [next(csv.reader([r[0]])) for r in lines.limit(2).collect()]
    if len(head) < 2 or len(head[0]) != len(head[1]):
        raise ValueError(f"{path} has no two header rows of the same length")
    names = sorted({a.strip() for a in head[0][1:]})
    at: dict[str, dict[str, int]] = {}
    for i, (a, s) in enumerate(zip(head[0], head[1], strict=True)):
        if i:
            at.setdefault(s.strip(), {}).setdefault(a.strip(), i)
    where = [(list(at), [[places.get(a) for a in names] for places in at.values()])]
    header = spark.createDataFrame(where, "s array<string>, p array<array<int>>")
    cells = lines.select(_cells(F.col("value")).alias("c"))
    both = cells.withColumn("ts", F.try_to_timestamp(F.col("c")[0]).cast("date")).where("ts is not null").join(F.broadcast(header))

    def stock(place: Column, i: Column) -> Column:
        values = [clean(F.get("c", place[k]).try_cast("double")).alias(f"v{k}") for k in range(len(names))]
        return F.struct(F.get("s", i).alias("stock"), *values)

    return both.select("ts", F.inline(F.transform("p", stock))).toDF("ts", "stock", *names)


def write_wide_csv(df: DataFrame, path: str) -> None:
    """A panel as CSV with two header rows (attributes, stocks) and a line a date.

    Lines are put together in parallel, by date; one task then writes them one
    after another to a single file, which is what the format asks for. A date's
    cells are one line, so they fit in a row. Of repeated rows one is written.
    """
    names = values(df)
    quoted = F.when(F.col("s").rlike('[,"]'), F.concat(F.lit('"'), F.replace("s", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("s"))
    line = lambda first, cells: F.array_join(F.concat(F.array(first), *cells), ",")
    named = df.select(F.col("stock").cast("string").alias("s")).where("s is not null").distinct().select("s", quoted.alias("q"))
    stocks = named.agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "q"))), lambda x: x["q"]).alias("q"))
    heads = [line(F.lit("attribute"), [F.array_repeat(F.lit(a), F.size("q")) for a in names]), line(F.lit("stock"), [F.col("q")] * len(names))]
    head = stocks.select(F.inline(F.array(*[F.struct(F.lit(i).alias("o"), F.lit(None).cast("date").alias("ts"), h.alias("value")) for i, h in enumerate(heads)])))
    dense = densify(df.where("ts is not null and stock is not null").dropDuplicates(list(KEY)))
    held = dense.groupBy("ts").agg(F.array_sort(F.collect_list(F.struct(F.col("stock").cast("string").alias("s"), *[F.col(c).cast("string").alias(f"v{k}") for k, c in enumerate(names)]))).alias("cells"))
    text = [_texts(k) for k in range(len(names))]
    data = held.select(F.lit(2).alias("o"), "ts", line(F.col("ts").cast("string"), text).alias("value"))
    head.union(data).repartition(1).sortWithinPartitions("o", "ts").select("value").write.mode("overwrite").text(path)


def _texts(k: int) -> Column:
    return F.transform("cells", lambda x: F.coalesce(x[f"v{k}"], F.lit("")))


def read_panel(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A long Parquet panel, or a wide CSV, by the name's end. NaN and infinities become null."""
    if path.endswith(".csv"):
        df = read_wide_csv(spark, path)
    elif path.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"neither .csv nor .parquet: {path}")
    df = df.select(*KEY, *columns) if columns else df
    return df.select(*[clean(c).cast(t).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at path; None if nothing is there. Other errors are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The panel at path; an empty one of that schema if there is none."""
    found = read_if_there(spark, path)
    return spark.createDataFrame([], schema) if found is None else found


def write_panel(df: DataFrame, path: str) -> None:
    """Long Parquet in folders by year, so that a range of dates reads its years only."""
    df.withColumn("year", F.year("ts")).repartition("year").write.mode("overwrite").partitionBy("year").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def cache_key(source: str, names: list[str], **params) -> str:
    """A name for computed factors that changes with the data's name, the factors and their parameters."""
    told = json.dumps([source, sorted(names), params], sort_keys=True, default=str)
    return hashlib.sha256(told.encode()).hexdigest()[:16]


def write_horizon(df: DataFrame, folder: str, holding_period: int) -> None:
    """Results of a holding period (regressions, weights), in a folder of their own: those of others stay."""
    df.withColumn("holding_period", F.lit(holding_period)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("holding_period").parquet(folder)


def read_horizon(spark: SparkSession, folder: str, holding_period: int) -> DataFrame | None:
    """What write_horizon() wrote for a holding period; None if it wrote nothing."""
    return read_if_there(spark, f"{folder}/holding_period={holding_period}")


def read_industry_ranges(spark: SparkSession, path: str) -> DataFrame:
    """low, high, industry, place from the public text format of industry
    definitions: a line with number and short name, then lines `0100-0199 ...`."""
    lines = spark.read.text(path, wholetext=True)
    rows = lines.select(F.posexplode(F.split("value", "\n"))).select("pos", F.trim("col").alias("line"))
    named = rows.select("pos", F.regexp_extract("line", r"^\d+\s+([A-Za-z]+)\s", 1).alias("name"), F.regexp_extract("line", r"^(\d{4})-(\d{4})", 1).alias("low"), F.regexp_extract("line", r"^(\d{4})-(\d{4})", 2).alias("high"))
    up = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    known = named.withColumn("industry", F.last(F.when((F.col("name") != "") & (F.col("low") == ""), F.col("name")), ignorenulls=True).over(up))
    return known.where("low <> ''").select(F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high"), "industry", F.col("pos").alias("place"))
