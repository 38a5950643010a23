"""Incremental ingestion of bars: files that land are read once, and replace their dates or find their place among earlier bars."""

from __future__ import annotations

import bisect
import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quantloom.streaming import snapshot


def landed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the rows of Parquet files that appear in folder."""
    return spark.readStream.schema(schema).parquet(folder)


def upsert_stream(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keeps the snapshot table up to date with a stream of bars, date by date, then stops.

    Readers see a batch as a whole; one that is done again after a failure is taken once.
    """
    take = lambda batch, i: snapshot.upsert(batch, table, checkpoint, i)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What ordered_bars() gives, and what it remembers of a stock.
ORDERED = "ts date, stock string, close double, ret double, seq long, version long, status string"
MEMORY = "n long, cut boolean, days array<long>, seqs array<long>, closes array<double>"
EPOCH = dt.date(1970, 1, 1)


class _Ordered(StatefulProcessor):
    """A stock's last bars, so that one that comes late finds its place among them."""

    def __init__(self, late: int):
        self.late = late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bars", MEMORY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        n, cut, days, seqs, closes = (*held[:2], *(list(x or []) for x in held[2:])) if held else (0, False, [], [], [])
        given = pd.concat(list(rows))
        out = []

        def told(i: int, status: str) -> None:
            nonlocal n
            n += 1
            before = closes[i - 1] if i and closes[i - 1] else None
            ret = None if before is None or closes[i] is None else closes[i] / before - 1
            out.append((EPOCH + dt.timedelta(days[i]), key[0], closes[i], ret, seqs[i], n, status))

        for ts, seq, close in sorted(zip(given["ts"], given["seq"], given["close"], strict=True), key=lambda r: (r[0], r[1])):
            day, seq, close = (ts - EPOCH).days, int(seq), None if pd.isna(close) else float(close)
            i = bisect.bisect_left(days, day)
            there = i < len(days) and days[i] == day
            # without the bar before it, what a late one returns can't be told
            if days and (day < days[-1] - self.late or (cut and i == 0)):
                n += 1
                out.append((ts, key[0], close, None, seq, n, "late"))
            elif there and seqs[i] >= seq:
                n += 1
                out.append((ts, key[0], close, None, seq, n, "stale"))
            else:
                if there:
                    seqs[i], closes[i] = seq, close
                else:
                    for held_, x in ((days, day), (seqs, seq), (closes, close)):
                        held_.insert(i, x)
                told(i, "corrected" if there else "new")
                if i + 1 < len(days):
                    told(i + 1, "moved")
        keep = max(0, bisect.bisect_left(days, days[-1] - self.late) - 1) if days else 0
        self.state.update((n, cut or keep > 0, days[keep:], seqs[keep:], closes[keep:]))
        yield pd.DataFrame(out, columns=["ts", "stock", "close", "ret", "seq", "version", "status"])

    def close(self) -> None:
        pass


def ordered_bars(stream: DataFrame, late: int = 3650) -> DataFrame:
    """The bars of a stream (ts, stock, close, seq) with the return since the stock's bar
    before, whatever the order in which they come.

    A bar that comes late takes its place, and the one after it is given anew
    (status moved); one of a day that is there corrects it if its seq is larger
    (corrected, else stale, without effect). More than `late` days behind the
    stock's last bar it is refused (late). Of rows of a stock and day the one
    with the largest version counts. What is kept of a stock is `late` days and
    the bar before those. Rows without a day, stock or seq are left out.
    """
    rows = stream.where("ts is not null and stock is not null and seq is not null").select("ts", F.col("stock").cast("string").alias("stock"), F.col("close").cast("double").alias("close"), F.col("seq").cast("long").alias("seq"))
    return rows.groupBy("stock").transformWithStateInPandas(_Ordered(late), ORDERED, "update", "none")


def ordered_stream(stream: DataFrame, table: str, checkpoint: str, late: int = 3650) -> StreamingQuery:
    """ordered_bars() kept in a snapshot table of ORDERED's columns (without what had no effect), then stops.

    Its state lives beside the checkpoint, so the next run goes on where this one ended."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def take(batch: DataFrame, i: int) -> None:
        snapshot.merge(batch.where("status not in ('late', 'stale')"), table, ["ts", "stock"], "version", checkpoint, i)

    return ordered_bars(stream, late).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_bars(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """start, key, open, high, low, close, n by tumbling windows; streams drop what is later than `late`."""
    order = F.struct(time, value)
    df = events.withWatermark(time, late) if events.isStreaming else events
    bars = df.groupBy(F.window(time, width).alias("w"), key).agg(F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count("*").alias("n"))
    return bars.select(F.col("w.start").alias("start"), key, "open", "high", "low", "close", "n")
