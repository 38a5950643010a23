"""Wide files, landed data, snapshots and streams that resume."""

import datetime as dt
import glob
import threading

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.sources import connector, files
from quantloom.streaming import ingest, snapshot

SCHEMA = "ts date, stock string, x double"


def panel(spark, rows):
    return spark.createDataFrame([(dt.date.fromisoformat(d), s, x) for d, s, x in rows], SCHEMA)


def table_rows(spark, table, **at):
    return sorted((str(r.ts), r.stock, r.x) for r in snapshot.read(spark, table, SCHEMA, **at).collect())


def test_wide_file_there_and_back(spark, tmp_path):
    rows = [("2024-01-02", "a,b", 1.5, None), ("2024-01-02", 'c"d', -2e-9, 3.0), ("2024-01-03", "a,b", float("nan"), 1e300), ("2024-01-03", "a,b", float("nan"), 1e300), (None, "a,b", 1.0, 1.0), ("2024-01-02", None, 1.0, 1.0)]
    df = spark.createDataFrame([(d and dt.date.fromisoformat(d), *r) for d, *r in rows], "ts date, stock string, `close of day` double, volume double")
    path = str(tmp_path / "w.csv")
    files.write_wide_csv(df, path)
    assert len(glob.glob(f"{path}/part*")) == 1
    got = {(str(r.ts), r.stock): tuple(r)[2:] for r in files.read_panel(spark, path).collect()}
    assert got == {("2024-01-02", "a,b"): (1.5, None), ("2024-01-02", 'c"d'): (-2e-9, 3.0), ("2024-01-03", "a,b"): (None, 1e300), ("2024-01-03", 'c"d'): (None, None)}


def test_wide_files_of_odd_lines(spark, tmp_path):
    (tmp_path / "p.csv").write_text('attribute,close,close,close,"a ""b"""\nstock,x,"y, inc",x,x\nts,,,,\n2024-01-02,1,"2",9\n"2024-01-03 00:00:00",inf,"1,5","",7,8,9\nnone,1,2,3,4\n')
    got = {(str(r.ts), r.stock): (r.close, r['a "b"']) for r in files.read_wide_csv(spark, str(tmp_path / "p.csv")).collect()}
    assert got == {("2024-01-02", "x"): (1.0, None), ("2024-01-02", "y, inc"): (2.0, None), ("2024-01-03", "x"): (None, 7.0), ("2024-01-03", "y, inc"): (None, None)}
    (tmp_path / "q.csv").write_text("attribute,a\nstock\n")
    with pytest.raises(ValueError, match="header"):
        files.read_wide_csv(spark, str(tmp_path / "q.csv"))


def test_plan_of_a_wide_file_does_not_grow(spark, tmp_path):
    sizes = []
    for n in (3, 2000):
        df = spark.range(n * 2).selectExpr("date_add(date'2024-01-01', cast(id % 2 as int)) ts", "cast(id div 2 as string) stock", "id * 0.5 a", "id * 2.0 b")
        files.write_wide_csv(df, f"{tmp_path}/{n}.csv")
        back = files.read_wide_csv(spark, f"{tmp_path}/{n}.csv")
        plan = back._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hash" not in plan and back.exceptAll(df.selectExpr("ts", "stock", "cast(a as double) a", "cast(b as double) b")).count() == 0 and back.count() == n * 2
        sizes.append(len(plan))
    assert abs(sizes[0] - sizes[1]) < 200


def test_readers_see_a_batch_whole(spark, tmp_path):
    t = str(tmp_path / "t")
    assert table_rows(spark, t) == [] and snapshot.version(spark, t) == 0
    assert snapshot.upsert(panel(spark, [("2024-01-01", "a", 1.0), ("2024-01-02", "a", 2.0)]), t) == 1
    reader = snapshot.read(spark, t, SCHEMA)
    bad = panel(spark, [("2024-01-01", "b", 9.0), ("2024-01-02", "b", 9.0)]).withColumn("x", F.when(F.col("ts") == "2024-01-02", F.raise_error(F.lit("no")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="no"):
        snapshot.upsert(bad, t)
    assert snapshot.version(spark, t) == 1 and table_rows(spark, t) == [("2024-01-01", "a", 1.0), ("2024-01-02", "a", 2.0)]
    assert snapshot.upsert(panel(spark, [("2024-01-02", "b", 3.0), (("2024-01-03"), "b", 4.0)]), t) == 2
    assert sorted(r.x for r in reader.collect()) == [1.0, 2.0]  # began before
    assert table_rows(spark, t) == [("2024-01-01", "a", 1.0), ("2024-01-02", "b", 3.0), ("2024-01-03", "b", 4.0)]
    assert table_rows(spark, t, at=1) == [("2024-01-01", "a", 1.0), ("2024-01-02", "a", 2.0)]
    snapshot.upsert(snapshot.read(spark, t, SCHEMA), t)  # all in one version
    assert len(snapshot.vacuum(spark, t)) == 2  # those of old states
    assert snapshot.vacuum(spark, t) == [] and len(table_rows(spark, t)) == 3


def test_a_batch_of_a_stream_is_taken_once(spark, tmp_path):
    t = str(tmp_path / "t")
    for _ in range(2):
        snapshot.upsert(panel(spark, [("2024-01-01", "a", 1.0)]), t, "s", 0)
    assert snapshot.version(spark, t) == 1
    snapshot.upsert(panel(spark, [("2024-01-01", "a", 2.0)]), t, "s", 1)
    snapshot.upsert(panel(spark, [("2024-01-01", "a", 9.0)]), t, "s", 0)
    assert table_rows(spark, t) == [("2024-01-01", "a", 2.0)]


def test_two_writers(spark, tmp_path):
    t = str(tmp_path / "t")
    work = [threading.Thread(target=snapshot.upsert, args=(panel(spark, [(f"2024-01-0{i}", "a", float(i))]), t)) for i in range(1, 6)]
    for w in work:
        w.start()
    for w in work:
        w.join()
    assert snapshot.version(spark, t) == 5 and [r[2] for r in table_rows(spark, t)] == [1.0, 2.0, 3.0, 4.0, 5.0]
    store = snapshot._Store(spark, t)
    assert not store.publish("_manifests/000000000005.json", {}) and store.names("_drafts") == []


def test_one_writer_gets_a_number(spark, tmp_path):
    """Writers want the same name: one gets it, what is read is theirs, and no second file (of sums) comes after it."""
    store = snapshot._Store(spark, str(tmp_path / "t"))
    for k in range(10):
        got, gate = {}, threading.Barrier(6)

        def one(i, name=f"_manifests/{k:012}.json", got=got, gate=gate):
            gate.wait()
            got[i] = store.publish(name, {"writer": i})

        work = [threading.Thread(target=one, args=(i,)) for i in range(6)]
        for w in work:
            w.start()
        for w in work:
            w.join()
        assert sorted(got.values()) == [False] * 5 + [True]
        assert got[store.read(f"_manifests/{k:012}.json")["writer"]]
    assert store.names("_drafts") == []
    assert sorted(p.name for p in (tmp_path / "t/_manifests").iterdir()) == [f"{k:012}.json" for k in range(10)]


def test_rows_are_merged(spark, tmp_path):
    t = str(tmp_path / "t")
    snapshot.upsert(panel(spark, [("2024-01-01", "a", 1.0), ("2024-01-02", "a", 2.0), ("2024-01-02", "b", 5.0)]), t)
    snapshot.merge(panel(spark, [("2024-01-02", "a", 7.0), ("2024-01-02", "b", 4.0), ("2024-01-02", "c", 1.0)]), t, ["ts", "stock"], "x")
    assert table_rows(spark, t) == [("2024-01-01", "a", 1.0), ("2024-01-02", "a", 7.0), ("2024-01-02", "b", 5.0), ("2024-01-02", "c", 1.0)]


def land(spark, path, batch, rows):
    df = spark.createDataFrame(rows, "ts string, ticker string, close double, timestamp long, more string")
    df.write.partitionBy("ts").json(f"{path}/{batch}")


def test_landed_bars(spark, tmp_path):
    path = str(tmp_path / "land")
    land(spark, path, "1", [(f"2024-01-0{i}", "a", float(i), 5, "x") for i in range(1, 8)] + [("2024-01-01", "a", 9.0, 6, "x"), ("2024-01-01", None, 1.0, 1, "x")])
    land(spark, path, "2", [("2024-01-03", "a", 30.0, 1, "later batch")])
    land(spark, path, "3", [("2024-01-04", "a", 40.0, 1, "not complete")])
    (tmp_path / "land/3/_SUCCESS").unlink()
    (tmp_path / "land/1/2024-01-09.json").write_text("")
    raw = connector.landed(spark, "bars", path)
    assert {(str(r.ts), r.close) for r in connector.latest_bars(raw).collect()} == {("2024-01-01", 9.0), ("2024-01-02", 2.0), ("2024-01-03", 30.0), *((f"2024-01-0{i}", float(i)) for i in range(4, 8))}
    # a partition a landed day, and only days asked for
    assert raw.rdd.getNumPartitions() == 9
    some = raw.where("ts > date'2024-01-02' and ts <= date'2024-01-03'")
    assert some.rdd.getNumPartitions() == 2 and some.count() == 2
    assert raw.where("ts in (date'2024-01-01', date'2024-01-05')").rdd.getNumPartitions() == 2
    assert raw.where("ts = date'2023-01-01'").count() == 0 and connector.landed(spark, "bars", f"{path}/none").count() == 0


def test_stream_of_landed_bars_resumes(spark, tmp_path):
    path, log = str(tmp_path / "land"), str(tmp_path / "log")
    seen = []

    def run():
        seen.clear()
        rows = connector.landed(spark, "bars", path, stream=True)
        rows.writeStream.foreachBatch(lambda b, _: seen.extend((str(r.ts), r.close) for r in b.collect())).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
        return sorted(seen)

    land(spark, path, "1", [("2024-01-01", "a", 1.0, 1, ""), ("2024-01-02", "a", 2.0, 1, "")])
    assert run() == [("2024-01-01", 1.0), ("2024-01-02", 2.0)]
    assert run() == []
    land(spark, path, "2", [("2024-01-01", "a", 3.0, 1, "a correction")])
    assert run() == [("2024-01-01", 3.0)]


def test_landed_statements(spark, tmp_path):
    rows = [("2024-02-01", ["a", "b"], "annual", 1, 5.0, None), ("2024-02-01", ["a"], "annual", 2, None, 7.0), ("2024-02-01", ["a"], "quarterly", 3, 9.0, None)]
    spark.createDataFrame(rows, "ts string, tickers array<string>, timeframe string, seq long, ebitda double, net_income double").write.partitionBy("ts").json(str(tmp_path / "1"))
    raw = connector.landed(spark, "statements", str(tmp_path))
    assert {r.stock: (r.ebitda, r.net_income) for r in connector.latest_statements(raw).collect()} == {"a": (5.0, 7.0), "b": (5.0, None)}
    assert {r.stock: (r.ebitda, r.net_income) for r in connector.latest_statements(raw, strict=True).collect()} == {"a": (None, 7.0), "b": (5.0, None)}


def test_bars_out_of_order(spark, tmp_path):
    """Three runs over mixed days give what one pass over all gives; what is too late is refused."""
    schema = "ts date, stock string, close double, seq long"
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(i)
    bars = [(day(i), s, float(7 + (i * 13 + ord(s)) % 11), 2) for s in "ab" for i in range(30) if (i + ord(s)) % 7]
    runs = [[b for b in bars if b[0].day % 3 == k] for k in (1, 0, 2)]
    runs[0] += [(d, s, c + 1, 1) for d, s, c, _ in runs[1]]  # wrong ones first
    runs[2] += [(d, s, c + 5, 1) for d, s, c, _ in runs[0] if s == "a"] + [(None, "a", 1.0, 1), (day(0), None, 1.0, 1)]
    for rows in runs:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ordered_stream(ingest.landed(spark, str(tmp_path / "in"), schema), str(tmp_path / "t"), str(tmp_path / "log")).awaitTermination()
    got = snapshot.read(spark, str(tmp_path / "t"), ingest.ORDERED).select("ts", "stock", "close", F.round("ret", 12).alias("ret"))
    want = spark.createDataFrame(bars, schema).withColumn("ret", F.round(F.col("close") / F.lag("close").over(Window.partitionBy("stock").orderBy("ts")) - 1, 12)).drop("seq")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    late = [[(day(0), "a", 1.0, 1), (day(20), "a", 2.0, 1)], [(day(15), "a", 3.0, 1), (day(3), "a", 4.0, 1), (day(0), "a", 9.0, 2), (day(20), "a", 5.0, 1)], [(day(12), "a", 6.0, 1)]]
    told = []
    for i, rows in enumerate(late):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "late"))
        stream = ingest.ordered_bars(ingest.landed(spark, str(tmp_path / "late"), schema), late=10)
        stream.writeStream.outputMode("update").foreachBatch(lambda b, _, i=i: told.extend((i, r.ts.day - 1, r.close, r.ret, r.status) for r in b.collect())).option("checkpointLocation", str(tmp_path / "latelog")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(told, key=str) == sorted([
        (0, 0, 1.0, None, "new"), (0, 20, 2.0, 1.0, "new"),
        (1, 0, 9.0, None, "late"), (1, 3, 4.0, None, "late"), (1, 15, 3.0, 2.0, "new"), (1, 20, 2.0, 2.0 / 3 - 1, "moved"), (1, 20, 5.0, None, "stale"),
        (2, 12, 6.0, 5.0, "new"), (2, 15, 3.0, -0.5, "moved"),
    ], key=str)
