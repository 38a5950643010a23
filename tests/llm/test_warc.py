import gzip
import hashlib

import pytest

from quantloom.llm import warc

BIG, SMALL = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 100, "tiny"
PAGES = [
    (1, "http://a.example/x?y=1", BIG),
    (2, "https://b.example", BIG),
    (3, "nonsense\r\nEvil: 1", BIG + "!"),
    (4, None, SMALL),
    (5, "http://a.example/", SMALL),
    (6, "http://c.example/", None),
    (None, "http://d.example/", BIG),
    (7, "http://e.example/", ""),
    (2, "https://b.example", BIG),
    (2, "https://other.example", BIG),
    (4, None, SMALL),
]


def brute(pages):
    first = {}
    for i, _, h in pages:
        b = (h or "").encode()
        if len(b) >= 1000:
            first.setdefault(b, []).append(i)
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        of = first.get(b, [])
        best = max((x for x in of if x is not None), default=None)
        again = len(of) > 1 and best is not None and i != best
        out.append((str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", str(best) if again else None))
    return sorted(out, key=str)


def result(spark, tmp_path, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "url as value", "page_id as id")
    path = f"file://{tmp_path}/warc"
    warc.write(warc.records(df.repartition(3)), path)
    return warc.read(spark, path)


def test_round_trip(spark, tmp_path):
    recs = result(spark, tmp_path, PAGES).cache()
    assert recs.count() == 3 * len(PAGES) == recs.select("record_id").distinct().count()
    caps = warc.captures(recs)
    assert caps.count() == len(PAGES) and caps.where("request is null or metadata is null").count() == 0
    got = sorted(((str(r.id), r.payload_bytes, r.payload_digest, r.type, r.refers_to) for r in warc.resolved(caps).collect()), key=str)
    assert got == brute(PAGES)
    html = {r.payload.decode() for r in recs.where("type = 'response'").collect()}
    assert html == {BIG, BIG + "!", SMALL, ""}
    assert recs.where("http_header like '%Evil: 1%' and type <> 'request'").count() == 0


def test_of_nothing(spark, tmp_path):
    assert warc.captures(result(spark, tmp_path, PAGES).limit(0)).count() == 0


def record(kind, rid, block, *more):
    head = "\r\n".join(["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", *more, f"Content-Length: {len(block)}"])
    return (head + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """A member for each record, junk between records, links in the other direction, strays."""
    one = record("response", "r1", b"HTTP/1.1 200 OK\r\n\r\nbody", "WARC-Concurrent-To: q1", "Content-Type: application/http; msgtype=response")
    two = record("request", "q1", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request")
    three = record("metadata", "m9", b"a: b\r\n", "WARC-Concurrent-To: r7", "Content-Type: application/warc-fields")
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.warc.gz").write_bytes(b"".join(map(gzip.compress, (one, two, three))))
    (tmp_path / "a/y.warc").write_bytes(record("response", "r2", b"junk\r\n\r\nWARC/1.0") + b"what\r\n")
    caps = {r.capture_id: r for r in warc.captures(warc.read(spark, str(tmp_path / "a"))).collect()}
    assert set(caps) == {"r1", "r2"}
    assert caps["r1"].request.record_id == "q1" and caps["r1"].metadata is None and bytes(caps["r1"].response.payload) == b"body"
    assert bytes(caps["r2"].response.payload) == b"junk\r\n\r\nWARC/1.0"


def test_cut_off_archive():
    with pytest.raises(ValueError):
        list(warc.parse(record("response", "r", b"0123456789")[:-8]))
    assert list(warc.parse(b"")) == []
