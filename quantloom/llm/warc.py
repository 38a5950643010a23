"""WARC archives: records of captures written and read, and transactions assembled.

A capture is three records: the response (or a revisit without payload, if
another capture has the same payload), the request and the metadata. The last
two name the first in WARC-Concurrent-To. Archives are written by Spark's text
writer, whose line separator is the end of a WARC record; so they may lie in
any store that Spark writes, and a lost task is written again as a whole.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.common import cut

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this many bytes are never revisits.
LEAST = 1000
#: Records in a file at most: a task holds one (compressed) file.
FILE_RECORDS = 6000
BATCH_BYTES = 8 << 20

SCHEMA = "record_id string, type string, concurrent_to array<string>, target_uri string, date string, refers_to string, payload_digest string, block_bytes long, http_header string, payload binary, fields map<string,string>"
_ARROW = pa.schema(
    [
        ("record_id", pa.string()),
        ("type", pa.string()),
        ("concurrent_to", pa.list_(pa.string())),
        ("target_uri", pa.string()),
        ("date", pa.string()),
        ("refers_to", pa.string()),
        ("payload_digest", pa.string()),
        ("block_bytes", pa.int64()),
        ("http_header", pa.string()),
        ("payload", pa.binary()),
        ("fields", pa.map_(pa.string(), pa.string())),
    ]
)


def _urn(*parts: Column) -> Column:
    """A name-based record id: 128 bits of the SHA-1 of the parts."""
    h = F.sha1(F.to_binary(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), F.lit("utf-8")))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _record(kind: Column | str, record_id: Column, date: str, uri: Column, block: Column, mime: str, more: list[Column]) -> Column:
    """A record without its end. more: whole header lines, null ones left out."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    lines = [
        F.lit("WARC/1.1"),
        line("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind),
        line("WARC-Record-ID", record_id),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        *more,
        line("Content-Type", F.lit(mime)),
        line("Content-Length", F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = "2024-01-01T00:00:00Z", least: int = LEAST) -> DataFrame:
    """One column, value: three records per row of pages.

    Of rows with equal payloads of `least` bytes or more, those with the largest
    id are responses, the rest revisits that refer to it (a null id counts as
    smaller than any; if all are null, all are responses). A null body is an
    empty payload; a null url leaves the target out; line ends in urls are
    percent-encoded. Repeated rows are captures of their own. Other columns are
    ignored.
    """
    p = pages.select(F.col(id_col).alias("_id"), F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A").alias("_url"), F.coalesce(F.col(body_col), F.lit("")).alias("_body"))
    p = p.withColumn("_sha", F.sha1(F.to_binary(F.col("_body"), F.lit("utf-8"))))
    # never null, so the join and the window below share one shuffle of payloads
    p = p.withColumn("_name", F.coalesce(F.concat(F.lit("="), F.col("_id").cast("string")), F.lit("")))
    # payloads stay where they are while groups are found; only ids and digests move
    narrow = p.where(F.octet_length("_body") >= least).select("_id", "_name", "_sha")
    several = narrow.groupBy("_sha").agg(F.count("*").alias("n"), F.max("_id").alias("_first")).where("n > 1 and _first is not null").select("_sha", "_first")
    revisits = narrow.join(several, "_sha").where(~F.col("_id").eqNullSafe(F.col("_first"))).select("_name", "_sha", "_first").distinct()
    both = p.join(revisits, ["_name", "_sha"], "left")
    same = Window.partitionBy("_name", "_sha").orderBy("_url")
    both = both.withColumn("_n", F.row_number().over(same))
    rid = lambda what, i, n: _urn(F.lit(what), i, F.col("_sha"), n)
    # the copy of a response that revisits name is the first one
    main_id = F.when(F.col("_first").isNull() & (F.col("_n") == 1), rid("response", F.col("_id"), F.lit(1))).otherwise(_urn(F.lit("capture"), F.col("_id"), F.col("_sha"), F.col("_url"), F.col("_n")))
    both = both.withColumn("_main", main_id)
    size = F.octet_length("_body").cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), size, F.lit(END))
    revisit = F.col("_first").isNotNull()
    main = _record(
        F.when(revisit, "revisit").otherwise("response"),
        F.col("_main"),
        date,
        F.col("_url"),
        F.when(revisit, head).otherwise(F.concat(head, F.col("_body"))),
        "application/http; msgtype=response",
        [
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("_sha")),
            F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), rid("response", F.col("_first"), F.lit(1)))),
            F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        ],
    )
    with_main = [F.concat(F.lit("WARC-Concurrent-To: "), F.col("_main"))]
    host = F.regexp_extract(F.coalesce("_url", F.lit("")), r"://([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce("_url", F.lit("")), r"://[^/?#]*([^#]*)", 1)
    ask = F.concat(F.lit("GET "), F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    request = _record("request", _urn(F.lit("request"), F.col("_main")), date, F.col("_url"), ask, "application/http; msgtype=request", with_main)
    told = F.concat(F.lit("payload-bytes: "), size, F.lit("\r\n"), F.coalesce(F.concat(F.lit(f"{id_col}: "), F.col("_id").cast("string"), F.lit("\r\n")), F.lit("")))
    metadata = _record("metadata", _urn(F.lit("metadata"), F.col("_main")), date, F.col("_url"), told, "application/warc-fields", with_main)
    return both.select(F.explode(F.array(request, main, metadata)).alias("value"))


def write(recs: DataFrame, path: str) -> None:
    """Writes records as gzip archives of a bounded number of records."""
    recs.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(data: bytes) -> Iterator[dict]:
    """The records of one archive, plain or gzip (of one member or one a record).

    Lines between records that don't begin one are passed over. An archive that
    ends within a record raises ValueError.
    """
    raw = io.BytesIO(data)
    f = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) if data[:2] == b"\x1f\x8b" else raw
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, list[str]] = {}
        while (line := f.readline()).strip(b"\r\n"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head.setdefault(name.strip().lower(), []).append(value.strip())
        one = lambda k, h=head: h.get(k, [None])[0]
        size = int(one("content-length") or 0)
        block = f.read(size)
        if len(block) < size:
            raise ValueError(f"the archive ends within record {one('warc-record-id')}")
        mime, http, payload, fields = one("content-type") or "", None, block, None
        if mime.startswith("application/http"):
            header, _, payload = block.partition(END.encode())
            http = header.decode("utf-8", "replace")
        elif mime.startswith("application/warc-fields"):
            pairs = (x.partition(":") for x in block.decode("utf-8", "replace").splitlines() if ":" in x)
            fields = [(a.strip(), b.strip()) for a, _, b in pairs]
        yield {
            "record_id": one("warc-record-id"),
            "type": one("warc-type"),
            "concurrent_to": head.get("warc-concurrent-to", []),
            "target_uri": one("warc-target-uri"),
            "date": one("warc-date"),
            "refers_to": one("warc-refers-to"),
            "payload_digest": re.sub(r"^sha1:", "", d) if (d := one("warc-payload-digest")) else None,
            "block_bytes": size,
            "http_header": http,
            "payload": payload,
            "fields": fields,
        }


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: SCHEMA, then payload_bytes and payload_sha1. Archives are
    decompressed as they are parsed, and rows leave in batches of bounded bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                rows, held = [], 0
                for r in parse(data.as_py()):
                    rows.append(r)
                    held += r["block_bytes"] + 500
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    recs = files.where("length > 0").select("content").mapInArrow(each, SCHEMA)
    return recs.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_sha1": F.sha1("payload")})


def captures(recs: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, then response (the response or
    revisit), request and metadata as structs of their records' columns.

    Requests and metadata join the response through WARC-Concurrent-To, which
    may stand in either of the two records. Where several match, the one of the
    smallest id stands; where none does, the struct is null. Requests and
    metadata that belong to no response are left out. Payloads need not be among
    the columns of recs; without them the joins move headers only.
    """
    cols = recs.columns
    main = recs.where(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), F.struct(*cols).alias("response"))
    out = main
    for kind in ("request", "metadata"):
        own = recs.where(F.col("type") == kind)
        one = own.select(F.explode("concurrent_to").alias("_to"), F.struct(*[c for c in cols if c != "payload"]).alias("_r"))
        back = main.select("capture_id", F.explode("response.concurrent_to").alias("_from"))
        back = back.join(own.select("record_id", F.struct(*[c for c in cols if c != "payload"]).alias("_r")), F.col("_from") == F.col("record_id")).select(F.col("capture_id").alias("_to"), "_r")
        got = one.union(back).groupBy("_to").agg(F.min_by("_r", "_r.record_id").alias(kind))
        out = out.join(got, F.col("capture_id") == F.col("_to"), "left").drop("_to")
    return out


def resolved(caps: DataFrame, id_field: str = "page_id") -> DataFrame:
    """Per capture: capture_id, id (from the metadata; null if not told), type,
    payload_bytes and payload_digest (of the full payload: a revisit's are those
    of the response it refers to), refers_to (that response's id)."""
    narrow = caps.select(
        "capture_id",
        F.col("metadata.fields")[id_field].alias("id"),
        F.col("response.type").alias("type"),
        F.col("response.payload_bytes").alias("bytes"),
        F.col("response.payload_sha1").alias("sha"),
        F.col("response.refers_to").alias("to"),
    )
    narrow = cut(narrow)
    said = narrow.where("type = 'response'").groupBy(F.col("capture_id").alias("_to")).agg(F.min("id").alias("_id"), F.min("bytes").alias("_bytes"), F.min("sha").alias("_sha"))
    # a response that a third of all captures refer to: with both sides written, Spark splits its partition
    both = narrow.join(cut(said), F.when(F.col("type") == "revisit", F.col("to")) == F.col("_to"), "left")
    again = F.col("type") == "revisit"
    pick = lambda a, b: F.when(again, F.col(a)).otherwise(F.col(b))
    return both.select("capture_id", "id", "type", pick("_bytes", "bytes").alias("payload_bytes"), pick("_sha", "sha").alias("payload_digest"), F.when(again, F.col("_id")).alias("refers_to"))
