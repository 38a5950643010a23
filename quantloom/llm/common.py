"""What several of the text operators share."""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.session import work_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def cut_path(spark: SparkSession, what: str = "cut") -> str:
    """A new path in the application's work folder, which driver and executors share (clear_work() removes it)."""
    return f"{work_folder(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df as a table written in the shared folder: later reads need no executor
    that has computed it. Unlike checkpoint(), it is computed once."""
    path = cut_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that serve up to a later one only. Once that is written, clear() takes
    them out of the shared folder, and has the JVM collect what refers to shuffles
    of finished jobs, for Spark removes shuffle files when it does."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, cut_path(spark, "scratch")

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        sc._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxed(df: DataFrame, *more: Column) -> DataFrame:
    """All columns of df in one struct, `row`, and beside it the columns `more`
    (of df): no name that is added can clash with those of df."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *more)


def row_tag(text: str) -> Column:
    """With the id, tells rows apart: rows equal in both have equal results."""
    return F.xxhash64(F.col(text), F.col(text).isNull())


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as the column `times` says, without that column."""
    keep = [c for c in df.columns if c != times]
    once = df.select(*keep, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias("_copy"))
    return once.drop("_copy")


def digests(df: DataFrame, keys: list[str], order: list[str], texts: dict[str, Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """keys, n (rows), for each of `texts` the SHA-256 (hex) of the group's texts
    one after another in the order given, and the totals of `sums`.

    Rows are sorted by Spark and stream through a task: a group may be of any
    size, for only its running digests are held. Texts and sums are made of
    df's columns after the exchange; null ones add nothing.
    """
    kinds, sums = dict(df.dtypes), sums or {}
    hashed, added = list(texts), list(sums)
    names = [*keys, "n", *hashed, *added]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now, n, running, total = None, None, 0, [], []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows], schema)

        def closed() -> tuple:
            return (*now, n, *(h.hexdigest() for h in running), *total)

        for b in batches:
            schema = schema or pa.schema([*(b.schema.field(i) for i in range(len(keys))), ("n", pa.int64()), *((t, pa.string()) for t in hashed), *((s, pa.int64()) for s in added)])
            done = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = row[: len(keys)]
                if key != now:
                    done += [closed()] if n else []
                    now, n, running, total = key, 0, [hashlib.sha256() for _ in hashed], [0] * len(added)
                n += 1
                for h, text in zip(running, row[len(keys) :], strict=False):
                    h.update((text or "").encode())
                total = [a + (x or 0) for a, x in zip(total, row[len(keys) + len(hashed) :], strict=True)]
            yield batch(done)
        if n:
            yield batch([closed()])

    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    rows = rows.select(*keys, *[c.alias(f"_t{i}") for i, c in enumerate(texts.values())], *[c.cast("long").alias(f"_s{i}") for i, c in enumerate(sums.values())])
    return rows.mapInArrow(each, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n long", *(f"{t} string" for t in texts), *(f"{s} long" for s in sums)]))
