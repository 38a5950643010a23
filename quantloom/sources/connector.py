"""Landed market data as Spark data sources: bars and statements, in batch and as streams.

A fetcher lands batches: folders named so that later ones sort behind earlier
ones, each with a JSON file (or a folder `ts=...` of them) for a day, and a file
_SUCCESS when all is there. A day of a batch is a partition; conditions on ts
reach the listing, so other days' files aren't opened. A stream's offset is the
last batch that it has read, so corrections of old days come as new batches.
"""

from __future__ import annotations

import datetime as dt
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs, json
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from quantloom.functions.scalar import clean
from quantloom.operators.panel import exploded_last
from quantloom.sources.landing import STATEMENT

FILE = re.compile(r"([^/]+)/(?:ts=)?(\d{4}-\d\d-\d\d)(?:/[^/]+)?\.json")
PRICES = ("open", "high", "low", "close", "volume", "vwap")
TYPES = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
TESTS = {
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
    EqualTo: lambda a, b: a == b,
    In: lambda a, b: a in b,
}


@dataclass
class Day(InputPartition):
    batch: str
    day: dt.date
    files: list[str]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """A file system that Arrow knows (local, hdfs, s3, gs), and the path in it."""
    return fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+:", path) else f"file://{path}")


class _Files:
    def __init__(self, path: str, fields: dict[str, str]):
        self.path, self.fields, self.tests = path, fields, []

    def days(self, after: str = "", to: str | None = None) -> list[Day]:
        """The days of complete batches, in order of batch and day."""
        store, top = _opened(self.path)
        found = [posixpath.relpath(x.path, top) for x in store.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True)) if x.is_file]
        done = {posixpath.dirname(x) for x in found if posixpath.basename(x) == "_SUCCESS"}
        days: dict[tuple, list[str]] = {}
        for name in sorted(found):
            m = FILE.fullmatch(name)
            if m and m[1] in done and after < m[1] and (to is None or m[1] <= to):
                day = dt.date.fromisoformat(m[2])
                if all(TESTS[kind](day, value) for kind, value in self.tests):
                    days.setdefault((m[1], day), []).append(name)
        return [Day(*k, v) for k, v in sorted(days.items())]

    def read(self, part: Day | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no day at all
            return
        store, top = _opened(self.path)
        wanted = pa.schema([(k, TYPES[v]) for k, v in self.fields.items()])
        options = json.ParseOptions(explicit_schema=wanted, unexpected_field_behavior="ignore")
        for name in part.files:
            if not store.get_file_info(f"{top}/{name}").size:
                continue
            with store.open_input_stream(f"{top}/{name}") as f:
                rows = json.read_json(f, json.ReadOptions(use_threads=False), options)
            n = len(rows)
            day, batch = pa.array([part.day] * n, pa.date32()), pa.array([part.batch] * n)
            table = pa.table([day, *(rows.column(c) for c in self.fields), batch], names=["ts", *self.fields, "landed"])
            yield from table.to_batches()


class _Reader(_Files, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in TESTS and f.attribute == ("ts",) and f.value is not None:
                self.tests.append((type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Day]:
        return self.days()


class _Stream(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"batch": ""}

    def latestOffset(self) -> dict:
        return {"batch": max((d.batch for d in self.days()), default="")}

    def partitions(self, start: dict, end: dict) -> list[Day]:
        return self.days(start["batch"], end["batch"])


class _Landed(DataSource):
    FIELDS: dict[str, str] = {}

    def schema(self) -> str:
        return ", ".join(["ts date", *(f"{k} {v}" for k, v in self.FIELDS.items()), "landed string"])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.FIELDS)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"], self.FIELDS)


class LandedBars(_Landed):
    """Bars: a JSON object a line, with the fields of a daily aggregate; unknown fields are left out."""

    FIELDS = {"ticker": "string", **dict.fromkeys(PRICES, "double"), "timestamp": "long"}

    @classmethod
    def name(cls) -> str:
        return "landed_bars"


class LandedStatements(_Landed):
    """Financial statements, by the day they were filed."""

    FIELDS = {"tickers": "array<string>", "timeframe": "string", "seq": "long", **dict.fromkeys(STATEMENT, "double")}

    @classmethod
    def name(cls) -> str:
        return "landed_statements"


def register(spark: SparkSession) -> None:
    """Makes the formats landed_bars and landed_statements known, and lets conditions reach them."""
    for source in (LandedBars, LandedStatements):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def landed(spark: SparkSession, kind: str, path: str, stream: bool = False) -> DataFrame:
    """The rows landed under path: ts, the fields of the kind (bars, statements) and the batch, landed."""
    register(spark)
    return (spark.readStream if stream else spark.read).format(f"landed_{kind}").option("path", path).load()


def latest_bars(raw: DataFrame) -> DataFrame:
    """ts, stock and prices: of several bars of a stock and day that of the last batch, and the latest in it. Rows without a ticker go."""
    best = F.max_by(F.struct(*PRICES), F.struct("landed", "timestamp", *PRICES))
    bars = raw.where("ticker is not null").groupBy("ts", F.col("ticker").alias("stock")).agg(best.alias("b"))
    return bars.select("ts", "stock", *[clean(F.col(f"b.{c}")).alias(c) for c in PRICES])


def latest_statements(raw: DataFrame, timeframe: str = "annual", strict: bool = False) -> DataFrame:
    """ts (day of filing), stock and the attributes, for one timeframe; see landing.statements()."""
    return exploded_last(raw.where(F.col("timeframe") == timeframe).select("ts", "tickers", "seq", *STATEMENT), "tickers", "seq", strict)
