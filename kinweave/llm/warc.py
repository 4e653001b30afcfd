"""Operator 5, WARC archives: written with revisits, read back by transaction assembly.

Each page becomes one capture of three records: request, response (or revisit), metadata. Request and metadata name the
response through WARC-Concurrent-To. Of pages with equal payloads (of at least `least` bytes) that with the largest key is
the response, the others are revisits that hold its headers alone and name it in WARC-Refers-To. Which page is which is
decided on (key, digest, number) alone; payloads then move once, by key and digest, and never by digest alone, as an empty
or error page may be a third of all. A capture's identifiers hold its page's key and its number in the scan, so they are
unique whatever the keys.

A task makes bundles of records of about ARCHIVE_BYTES, and Spark's own text writer gives each a gzip file of its own, so its
commit protocol covers lost executors and any store that Spark can write, and an archive is bounded by its bytes (a record
ends in CR LF CR LF; the last CR LF of a file is the writer's line separator).

Reading takes the archives as whole files, parses records by their Content-Length, checks the digests of the payloads that
are there, and joins the records of a capture by their concurrent-to identifiers into one nested row.

Defined cases: a null payload counts as empty; a null or unsafe URL is percent-encoded or replaced by the record's URN;
rows that repeat the largest key of their payload are all responses, and revisits name one of them; repeated and null keys
give one row each; pages of null keys alone with equal payloads are all responses; a payload beyond ARCHIVE_BYTES is an
archive of its own; an empty table gives an empty result; other columns are not read, whatever their names. Numbers come from
the scan: a frame whose rows come in another order each time is to be written first.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, small_batches

#: Bytes of records in an archive, beyond which it ends; a reading task holds one archive.
ARCHIVE_BYTES = 16_000_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
unsafe = re.compile(r"[\x00-\x20\x7f]")


def urn(key: int | None, number: int, kind: str) -> str:
    return f"<urn:capture:{'' if key is None else key}:{number}:{kind}>"


def record(kind: str, rid: str, uri: str, date: str, block: bytes, media: str, more: tuple[tuple[str, str], ...] = ()) -> bytes:
    """One WARC record, with the two line ends behind it."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", uri), *more, ("Content-Type", media), ("Content-Length", str(len(block)))]
    return b"".join((b"WARC/1.1\r\n", "".join(f"{k}: {v}\r\n" for k, v in head).encode(), b"\r\n", block, b"\r\n\r\n"))


def capture(key: int | None, number: int, url: str | None, payload: bytes, sha1: bytes, refers: dict | None, date: str) -> bytes:
    """The records of one page; refers: key and number of the page that holds the payload, of a revisit."""
    uri = unsafe.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:capture:{'' if key is None else key}:{number}"
    response = urn(key, number, "response")
    digest = "sha1:" + base64.b32encode(sha1).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers is None:
        main = record("response", response, uri, date, http + payload, "application/http;msgtype=response", (("WARC-Payload-Digest", digest),))
    else:
        more = (("WARC-Payload-Digest", digest), ("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers["key"], refers["number"], "response")))
        main = record("revisit", response, uri, date, http, "application/http;msgtype=response", more)
    to = (("WARC-Concurrent-To", response),)
    request = record("request", urn(key, number, "request"), uri, date, f"GET {uri} HTTP/1.1\r\n\r\n".encode(), "application/http;msgtype=request", to)
    fields = f"page: {'' if key is None else key}\r\n".encode()
    return request + main + record("metadata", urn(key, number, "metadata"), uri, date, fields, "application/warc-fields", to)


def write(df: DataFrame, out: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write all rows of df as archives under `out`."""
    pages = df.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("number", F.monotonically_increasing_id())
    thin = pages.where(F.octet_length("payload") >= least).select("key", "sha1", "number")
    main = thin.groupBy("sha1").agg(F.max(F.struct("key", "number")).alias("main"), F.count("*").alias("n")).where("n > 1 AND main.key IS NOT NULL").drop("n")
    # one row for each (key, digest) that refers; joined to the payloads by both, so that neither an empty page nor a null key is hot alone
    refers = thin.select("key", "sha1").distinct().join(main, "sha1").where(~F.col("key").eqNullSafe(F.col("main.key"))).select(F.col("key").alias("_key"), F.col("sha1").alias("_sha1"), "main")
    rows = pages.join(refers, F.col("key").eqNullSafe(F.col("_key")) & (F.col("sha1") == F.col("_sha1")), "left").select("key", "number", "url", "payload", "sha1", "main")
    most = ARCHIVE_BYTES

    def run(batches):
        bundle, held = [], 0
        for batch in batches:
            for x in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                bundle.append(capture(*x, date))
                held += len(bundle[-1])
                if held >= most:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(bundle)[:-2]], pa.binary())], names=["records"])
                    bundle, held = [], 0
        if bundle:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(bundle)[:-2]], pa.binary())], names=["records"])

    small_batches(df.sparkSession)
    bundles = rows.mapInArrow(run, "records binary").select(F.col("records").cast("string").alias("value"))
    bundles.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", 1).text(out)


def parse(data: bytes):
    """Records of an archive: (headers, block); raises ValueError on damage."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.", at) or end < 0:
            raise ValueError(f"no record at {at}")
        head = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        start = end + 4
        at = start + int(head["Content-Length"])
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record ends badly at {at}")
        yield head, view[start:at]
        at += 4


RECORD = "type string, id string, concurrent_to string, refers_to string, uri string, page long, payload_bytes long, payload_digest string, payload binary"


def read(spark: SparkSession, out: str, payloads: bool = True) -> DataFrame:
    """All records under `out`. Without payloads, digests and sizes alone leave the reader."""
    small_batches(spark)

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for head, block in parse(data.as_buffer().to_pybytes()):
                    kind, page, n, digest, body = head["WARC-Type"], None, None, None, None
                    if kind in ("response", "revisit"):
                        block = block.tobytes()
                        at = block.index(b"\r\n\r\n") + 4
                        n = int(re.search(rb"(?i)\r\ncontent-length: (\d+)\r\n", block[:at])[1])
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response":
                            body = block[at:]
                            if len(body) != n or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                                raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                    elif kind == "metadata":
                        page = re.search(rb"page: (-?\d+)\r\n", block)
                        page = page and int(page[1])
                    rows.append((kind, head["WARC-Record-ID"], head.get("WARC-Concurrent-To"), head.get("WARC-Refers-To"), head["WARC-Target-URI"], page, n, digest, body if payloads else None))
                kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                names = ["type", "id", "concurrent_to", "refers_to", "uri", "page", "payload_bytes", "payload_digest", "payload"]
                for lo in range(0, len(rows), 3000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + 3000], strict=True), kinds, strict=True)], names=names)

    files = spark.read.option("pathGlobFilter", "part-*").text(out, wholetext=True)
    return files.select(F.col("value").cast("binary")).mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: id, request, response (or revisit), metadata.

    Records meet by the identifier of the response that they are concurrent to; a response meets itself.
    """
    each = F.struct(*(c for c in records.columns if c != "concurrent_to"))
    of = lambda *kinds: F.first(F.when(F.col("type").isin(*kinds), each), ignorenulls=True)
    return records.groupBy(F.coalesce("concurrent_to", "id").alias("id")).agg(of("request").alias("request"), of("response", "revisit").alias("response"), of("metadata").alias("metadata"))


def digests(df: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages, read the archives back, and return page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = df.sparkSession
    out = scratch(spark)
    write(df, out, least=least)
    captures = assemble(read(spark, out, payloads=False))
    refers = F.regexp_extract("response.refers_to", r"^<urn:capture:(-?\d+):", 1)
    return captures.select(F.col("metadata.page").alias("page_id"), "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), F.when(refers != "", refers.cast("long")).alias("refers_to"))


#: The same in DuckDB; base32 by groups of five bits from the bits of the digest.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, octet_length(encode(t)) AS n, sha1(t) AS s FROM p),
b AS (SELECT *, array_to_string(list_transform(range(0, 40), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', (instr('0123456789abcdef', substr(s, CAST(i AS BIGINT) + 1, 1)) - 1) * 4 + 1, 4)), '') AS bits FROM d),
e AS (SELECT page_id, n, s, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (CASE WHEN substr(bits, CAST(i AS BIGINT) * 5 + 1, 1) = '1' THEN 16 ELSE 0 END) + (CASE WHEN substr(bits, CAST(i AS BIGINT) * 5 + 2, 1) = '1' THEN 8 ELSE 0 END) + (CASE WHEN substr(bits, CAST(i AS BIGINT) * 5 + 3, 1) = '1' THEN 4 ELSE 0 END) + (CASE WHEN substr(bits, CAST(i AS BIGINT) * 5 + 4, 1) = '1' THEN 2 ELSE 0 END) + (CASE WHEN substr(bits, CAST(i AS BIGINT) * 5 + 5, 1) = '1' THEN 1 ELSE 0 END), 1)), '') AS digest FROM b),
m AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS main FROM e)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = main THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> main THEN main END AS refers_to FROM m
"""
