"""Tables of dates that are replaced as a whole: readers see all of a batch or nothing of it.

A batch is written to a folder of its own, a version. A manifest names, for each
version that counts, its dates; it becomes the current one by being renamed to
the next number (on a local disk: linked to it), which fails if another writer was
first (then it is made anew from theirs). Old versions stay until vacuum(), so a reader's files don't go
while it reads. The store must rename a file in one step, as HDFS does.
"""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EMPTY = {"versions": {}, "batches": {}}


class _Store:
    """The few calls to Hadoop's file system that commits need."""

    def __init__(self, spark: SparkSession, table: str):
        self.jvm, self.conf, self.table = spark._jvm, spark._jsc.hadoopConfiguration(), table.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.table}/{name}" if name else self.table)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> dict:
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def publish(self, name: str, content: dict) -> bool:
        """Writes a file and gives it its name in one step; False if there is one already."""
        draft, target = self.path(f"_drafts/{uuid.uuid4().hex}"), self.path(name)
        out = self.fs.create(draft, False)
        out.write(json.dumps(content).encode())
        out.close()
        self.fs.mkdirs(target.getParent())
        at = self.fs.resolvePath(target.getParent()).toUri()
        if at.getScheme() == "file":  # Hadoop looks for the target first and renames then, file and checksum apart: two writers may both succeed
            try:
                os.link(self.fs.resolvePath(draft).toUri().getPath(), f"{at.getPath()}/{target.getName()}")
                return True
            except FileExistsError:
                return False
            finally:
                self.fs.delete(draft, False)
        none = SparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)  # an existing target is an error
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf).rename(self.fs.makeQualified(draft), self.fs.makeQualified(target), none)
            return True
        except Py4JJavaError:
            if not self.fs.exists(target):
                raise
            self.fs.delete(draft, False)
            return False

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _current(store: _Store) -> tuple[int, dict]:
    names = store.names("_manifests")
    return (int(names[-1].split(".")[0]), store.read(f"_manifests/{names[-1]}")) if names else (0, EMPTY)


def version(spark: SparkSession, table: str) -> int:
    """The number of the current state; 0 for a table that isn't there."""
    return _current(_Store(spark, table))[0]


def upsert(batch: DataFrame, table: str, source: str | None = None, batch_id: int = 0) -> int:
    """The dates (ts) of batch take the place of those of the table; the new version's number.

    source and batch_id name a batch of a stream: one that is in already isn't
    taken again. Nothing is seen of a batch that fails. Dates (few) come to the driver.
    """
    spark = batch.sparkSession
    store = _Store(spark, table)
    if source is not None and _current(store)[1]["batches"].get(source, -1) >= batch_id:
        return _current(store)[0]
    name = f"v{uuid.uuid4().hex}"
    path = f"{store.table}/data/_version={name}"
    batch.repartition("ts").write.partitionBy("ts").parquet(path)
    dates = [x.removeprefix("ts=") for x in store.names(f"data/_version={name}") if x.startswith("ts=")]
    while True:
        n, old = _current(store)
        new = {v: sorted(set(d).difference(dates)) for v, d in old["versions"].items()} | {name: dates}
        told = {"versions": {v: d for v, d in new.items() if d}, "batches": old["batches"] | ({source: batch_id} if source is not None else {})}
        if store.publish(f"_manifests/{n + 1:012}.json", told):
            return n + 1


def read(spark: SparkSession, table: str, schema: str, at: int | None = None) -> DataFrame:
    """The table as it is now, or as of version `at`; empty if it isn't there. schema: with ts.

    The folders of the dates that count are named one by one (a century has 37
    thousand), so a condition on ts opens only its own."""
    store = _Store(spark, table)
    told = _current(store)[1] if at is None else store.read(f"_manifests/{at:012}.json")
    kinds = spark.createDataFrame([], schema)
    paths = [f"{store.table}/data/_version={v}/ts={d}" for v, dates in told["versions"].items() for d in dates]
    if not paths:
        return kinds
    return spark.read.schema(f"{schema}, _version string").option("basePath", f"{store.table}/data").parquet(*paths).select(*kinds.columns)


def merge(batch: DataFrame, table: str, keys: list[str], newest: str, source: str | None = None, batch_id: int = 0) -> int:
    """Row by row: of the rows of the table and of batch that are equal in keys (ts among
    them) the one with the largest `newest` stays. Only the dates of batch are written."""
    spark = batch.sparkSession
    schema = ", ".join(f"{c} {t}" for c, t in batch.dtypes)
    there = read(spark, table, schema).join(batch.select("ts").distinct(), "ts", "left_semi").select(batch.columns)
    best = Window.partitionBy(*keys).orderBy(F.col(newest).desc())
    rows = there.union(batch).withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_place")
    return upsert(rows, table, source, batch_id)


def vacuum(spark: SparkSession, table: str, keep: int = 1) -> list[str]:
    """Removes all but the last `keep` manifests and the versions that none of those
    names; gives their names. Not while a writer or a reader of an older version is at work."""
    store = _Store(spark, table)
    names = store.names("_manifests")
    live = {v for x in names[-keep:] for v in store.read(f"_manifests/{x}")["versions"]}
    gone = [v for v in (x.removeprefix("_version=") for x in store.names("data")) if v not in live]
    for x in names[:-keep]:
        store.delete(f"_manifests/{x}")
    for v in gone:
        store.delete(f"data/_version={v}")
    return gone
