"""WARC archives: captures written as request, response (or revisit) and metadata records, and transactions assembled.

Writing: payloads are told apart by SHA-1. Of the records with equal payloads of at least MIN_REVISIT bytes the one with the
largest key is the response, the others revisit it; the largest key comes from an aggregation with partial maxima, and only
keys and digests meet in that join. A capture's records are one line of text with CRLF CRLF after each record, so the
archives are written by Spark's own text writer, with its commit of finished tasks, as gzip files of at most CAPTURES
captures.

Reading: an archive comes compressed from the binaryFile source, and its records are read one after the other by
Content-Length, so payloads may hold anything and no archive is unpacked whole. A record is a row.

Assembly: metadata and request records name the response or revisit that they belong to in WARC-Concurrent-To; they are
joined through it, and each capture is one nested row. Revisits find their original through WARC-Refers-To.

Defined cases: a null payload counts as empty; each row is a capture, repeated rows and rows without a key too (a null key is
less than any other, among equal keys any one row is the response); a null url is written as empty; an empty table gives no
archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import new_path, table, tidied, written

MIN_REVISIT = 0
CAPTURES = 20_000
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
RECORD = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, http_head string, payload binary"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 of the SHA-1, in JVM expressions: 15 hex digits are 12 digits of base 32. The SHA-1 is a
    lambda's argument, so that it is taken once for all of its digits, in branches too."""

    def letters(digits: Column) -> Column:
        parts = (F.lpad(F.conv(F.substring(digits, a, n), 16, 32), n * 4 // 5, "0") for a, n in ((1, 15), (16, 15), (31, 10)))
        return F.translate(F.concat(*parts), DIGITS32, BASE32)

    return F.transform(F.array(F.sha1(payload)), letters)[0]


def urn(name: Column, role: str) -> Column:
    """A record id that follows from a capture's name and the record's role, in the form of a UUID."""
    h = F.md5(F.concat(name, F.lit(f"/{role}")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its end: the version, the headers that aren't null, Content-Length in bytes, the block."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = MIN_REVISIT, captures: int = CAPTURES) -> None:
    """Writes a capture for each row under path."""
    pages = pages.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(payload, F.lit("")).alias("payload"))
    if pages.groupBy("key").count().where("count > 1").limit(1).count():  # rows of one key are told apart by numbers, written so that they stay
        pages = written(pages.withColumn("number", F.monotonically_increasing_id()), "warc-numbered")
    else:
        pages = pages.withColumn("number", F.lit(0).cast("long"))
    pages = pages.withColumn("name", F.concat_ws("/", F.coalesce(F.col("key").cast("string"), F.lit("")), F.col("number").cast("string")))
    pages = pages.withColumn("digest", base32_sha1(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload"))
    digests = written(pages.select("name", F.struct("key", "number", "name").alias("place"), "digest", "bytes"), "warc-digests")
    first = digests.where(F.col("bytes") >= min_revisit).groupBy("digest", "bytes").agg(F.max("place").alias("original"), F.count("*").alias("n")).where("n > 1")
    revisits = digests.join(first, ["digest", "bytes"]).where("name <> original.name").select("name", F.col("original.name").alias("original"))
    pages = pages.join(revisits, "name", "left")

    me = urn(F.col("name"), "response")
    uri = ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " "))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    kind = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = _record("response", [("WARC-Record-ID", me), uri, digest, kind], F.concat(http, F.col("payload")))
    revisit = _record("revisit", [("WARC-Record-ID", me), uri, digest, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", urn(F.col("original"), "response")), kind], http)
    concurrent = ("WARC-Concurrent-To", me)
    ask = F.concat(F.lit("GET "), uri[1], F.lit(f" HTTP/1.1{END}"))
    request = _record("request", [("WARC-Record-ID", urn(F.col("name"), "request")), uri, concurrent, ("Content-Type", F.lit("application/http; msgtype=request"))], ask)
    metadata = _record("metadata", [("WARC-Record-ID", urn(F.col("name"), "metadata")), uri, concurrent, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("capture-key: "), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit("\r\n")))
    line = F.concat_ws(END, request, F.when(F.col("original").isNull(), response).otherwise(revisit), metadata)
    pages.select(line.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", captures).text(path)


def parse_archive(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record; what lies between records is passed over."""
    while line := stream.readline():
        if line.startswith(b"WARC/"):
            headers = {}
            while line := stream.readline().rstrip(b"\r\n"):
                name, _, value = line.decode("utf-8", "replace").partition(":")
                headers[name.lower()] = value.strip()
            yield headers, stream.read(int(headers["content-length"]))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: RECORD. payload is what follows the HTTP head, or a metadata record's block."""
    names = ("warc-record-id", "warc-type", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-payload-digest")
    schema = pa.schema([*((n.split()[0], pa.string()) for n in RECORD.split(", ")[:7]), ("payload", pa.binary())])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for given in batches:
            for content in given.column(0):
                rows, size = [], 0
                raw = io.BytesIO(content.as_buffer())
                packed = raw.getbuffer()[:2] == b"\x1f\x8b"
                for headers, block in parse_archive(io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) if packed else raw):
                    head, payload = "", block
                    if headers.get("content-type", "").startswith("application/http"):
                        head, _, payload = (x if i else x.decode("latin-1") for i, x in enumerate(block.partition(b"\r\n\r\n")))
                    rows.append((*(headers.get(n) for n in names), head, payload))
                    size += len(block)
                    if size > 8 << 20:
                        yield batch()
                        rows, size = [], 0
                if rows:
                    yield batch()

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.where("length > 0").select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """A row per capture: record_id, and the structs capture, request and metadata. records: RECORD, or less or more columns
    in place of payload."""
    columns = [c for c in records.columns if c != "concurrent_to"]
    main = records.where(F.col("record_type").isin("response", "revisit")).select("record_id", F.struct(*columns).alias("capture"))
    side = records.where(F.col("record_type").isin("request", "metadata")).select(F.col("concurrent_to").alias("record_id"), "record_type", F.struct(*columns).alias("x"))
    of = lambda kind: F.min(F.when(F.col("record_type") == kind, F.col("x"))).alias(kind)
    return main.join(side.groupBy("record_id").agg(of("request"), of("metadata")), "record_id", "left")


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per page, out of the nested rows of its transactions: of the response and of its revisits the payload's size and
    digest, of the metadata the key, of the request its line. Payloads are measured on reading, before assembly."""
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    records = read_archives(spark, path)
    http_length = F.regexp_extract("http_head", r"(?i)content-length:\s*(\d+)", 1).try_cast("long")
    digest = F.regexp_replace("payload_digest", "^sha1:", "")
    key = F.when(F.col("record_type") == "metadata", F.regexp_extract(F.col("payload").cast("string"), r"capture-key: (-?\d+)", 1).try_cast("long"))
    read_back = F.col("record_type") == "response"  # of a response the payload itself is measured
    records = records.select(
        "record_id", "record_type", "concurrent_to", "refers_to", "target_uri", "http_head", key.alias("key"),
        F.when(read_back, F.octet_length("payload").cast("long")).otherwise(http_length).alias("payload_bytes"),
        F.when(read_back, base32_sha1(F.col("payload"))).otherwise(digest).alias("payload_digest"),
    )
    captures = written(assemble(written(records, "warc-records")), "warc-captures")
    captures = captures.select("record_id", F.col("metadata.key").alias("page_id"), "capture.payload_bytes", "capture.payload_digest", "capture.record_type", F.col("capture.refers_to").alias("original"), F.col("request.http_head").alias("request_line"))
    originals = captures.where("record_type = 'response'").select(F.col("record_id").alias("original"), F.col("page_id").alias("refers_to"))
    revisits = captures.where("record_type = 'revisit'").join(originals, "original", "left")
    responses = captures.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))  # refer to nothing, so meet in no join
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "request_line")
    return responses.select(*columns).unionByName(revisits.select(*columns))


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, 'GET ' || regexp_replace(coalesce(url, ''), '[\\r\\n]+', ' ', 'g') || ' HTTP/1.1' AS request_line FROM pages),
d AS (SELECT page_id, request_line, octet_length(b)::BIGINT AS payload_bytes, upper(sha1(b)) AS hex FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS original FROM d),
c AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> (15 - 5 * k)) & 31)::INT + 1, 1), '' ORDER BY i, k) AS payload_digest
  FROM (SELECT page_id, i, ('0x' || substr(hex, 5 * i + 1, 5))::BIGINT AS v FROM d, (SELECT unnest(range(8))::INT AS i)), (SELECT unnest(range(4))::INT AS k) GROUP BY page_id)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to, request_line FROM w JOIN c USING (page_id)
"""
