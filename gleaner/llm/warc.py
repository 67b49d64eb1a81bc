"""WARC archives of stored pages, and transactions assembled from them.

Every page becomes three records: a request, a response or a revisit, and a metadata record; the first and
the last name the second in WARC-Concurrent-To. Of pages with equal payloads the one with the least page_id is
the response, the others are revisits without payload that carry its digest and address. Archives are plain
WARC 1.1 files under gzip, written by Spark's text sink, whose line separator is the end mark of a record, and
read back as binary files by the lengths in their headers. Reading joins the records of a capture again.

Only the narrow table (page_id, digest) meets by payload; the pages themselves are dealt by page_id.

Defined cases: null html is an empty payload; a null url is written as ``about:blank``; empty payloads are
payloads like any other; a null page_id counts as larger than any number; rows that repeat page_id and
payload are all written as responses, each with record ids of its own; extra columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import checkpoint_dir, materialize

DATE = "2024-01-01T00:00:00Z"
RECORDS_PER_FILE = 6000
MIN_REVISIT_BYTES = 0
END = "\r\n\r\n"

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_RECORD = "record_id string, kind string, concurrent_to string, uri string, refers_to_uri string, payload_digest string, block binary"


def sha1_base32(text: Column) -> Column:
    """Base32 SHA-1 of a string's UTF-8 bytes; five hexadecimal digits are four characters."""
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(F.sha1(text), i * 5 + 1, F.lit(5)), 16, 10).cast("int")
    )

    def letters(part: Column) -> Column:
        return F.concat(*[F.substring(F.lit(_BASE32), F.shiftright(part, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(parts, letters), "")


def _record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its end mark; headers with a null value are left out."""
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``value``: the text of every record of ``pages (page_id, url, html)``."""
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce("url", F.lit("about:blank")), "[\r\n]", " ").alias("url"),  # headers are lines
        F.coalesce("html", F.lit("")).alias("html"),
    )
    narrow = materialize(
        page.select("page_id", "url", sha1_base32(F.col("html")).alias("digest"), F.octet_length("html").alias("bytes")), "digests"
    )
    first = narrow.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first"), F.count("*").alias("n")
    ).filter("n > 1").select("digest", F.col("first.page_id").alias("_of"), F.col("first.url").alias("_uri"))
    # what each page refers to, by page and digest; pages of one id may have several payloads
    refers = (
        narrow.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("_of")))
        .select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("_page"), "digest", "_of", "_uri").distinct()
    )
    keyed = page.withColumns({
        "digest": sha1_base32(F.col("html")), "_page": F.coalesce(F.col("page_id").cast("string"), F.lit("")), "_uuid": F.uuid(),
    })
    told = keyed.join(refers, ["_page", "digest"], "left")
    revisit = F.col("_of").isNotNull()

    def name(kind: str) -> Column:
        return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat("_uuid", F.lit(kind))), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))

    host = F.regexp_extract("url", "^[^:/]+://([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace("url", "^[^:/]+://[^/?#]*", ""), "#.*$", "")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    common = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("url"))]
    concurrent = ("WARC-Concurrent-To", name("main"))
    status = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    main = F.when(revisit, _record("revisit", [
        ("WARC-Record-ID", name("main")), *common, digest, ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To-Target-URI", F.col("_uri")), ("WARC-Refers-To-Date", F.lit(DATE)), ("Content-Type", F.lit("application/http;msgtype=response")),
    ], status)).otherwise(_record("response", [
        ("WARC-Record-ID", name("main")), *common, digest, ("Content-Type", F.lit("application/http;msgtype=response")),
    ], F.concat(status, F.col("html"))))
    request = _record("request", [
        ("WARC-Record-ID", name("request")), *common, concurrent, ("Content-Type", F.lit("application/http;msgtype=request")),
    ], F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END)))
    fields = F.concat_ws(
        "\r\n", F.concat(F.lit("page-id: "), F.col("_page")), F.concat(F.lit("payload-bytes: "), F.octet_length("html").cast("string")),
        F.concat(F.lit("refers-to-page: "), F.col("_of").cast("string")),
    )
    metadata = _record("metadata", [
        ("WARC-Record-ID", name("metadata")), *common, concurrent, ("Content-Type", F.lit("application/warc-fields")),
    ], fields)
    return told.select(F.explode(F.array(request, main, metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, per_file: int = RECORDS_PER_FILE) -> None:
    """Write ``pages`` as gzip archives of about ``per_file`` records each."""
    records(pages, min_bytes).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record of an uncompressed archive."""
    at, end = 0, END.encode()
    while at < len(data):
        cut = data.index(end, at)
        lines = data[at:cut].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        start = cut + len(end)
        stop = start + int(headers["content-length"])
        yield headers, data[start:stop]
        at = stop + len(end)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["warc-record-id", "warc-type", "warc-concurrent-to", "warc-target-uri", "warc-refers-to-target-uri", "warc-payload-digest"]
    fields = ["record_id", "kind", "concurrent_to", "uri", "refers_to_uri", "payload_digest", "block"]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string()] * 6 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=fields)

    for batch in batches:
        for content in batch.column("content"):
            rows, size = [], 0
            for headers, block in parse_records(zlib.decompress(content.as_py(), 47)):
                rows.append((*(headers.get(n) for n in names), block))
                size += len(block)
                if size > 8 << 20:
                    yield packed(rows)
                    rows, size = [], 0
            if rows:
                yield packed(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; a task holds one archive at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_read, _RECORD)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [x[x.index(END.encode()) + 4 :] for x in batch.column("http").to_pylist()]
        digests = [base64.b32encode(hashlib.sha1(x).digest()).decode() for x in found]
        out = {"body_bytes": pa.array([len(x) for x in found], pa.int64()), "body_digest": pa.array(digests, pa.string())}
        yield pa.RecordBatch.from_pydict({**{n: batch.column(n) for n in batch.schema.names}, **out})


def transactions(archive: DataFrame) -> DataFrame:
    """One nested row per capture: ``record_id, request, response, metadata``.

    Requests and metadata records are joined to the record that they are concurrent to. A capture without
    one of them has null there.
    """
    def part(kind: str) -> DataFrame:
        return archive.filter(F.col("kind") == kind).select(
            F.col("concurrent_to").alias("record_id"),
            F.struct(F.col("record_id").alias("id"), "uri", F.col("block").alias("block")).alias(kind),
        )

    main = archive.filter(F.col("kind").isin("response", "revisit")).select(
        "record_id", F.struct("kind", "uri", "refers_to_uri", "payload_digest", "block").alias("response")
    )
    return main.join(part("request"), "record_id", "left").join(part("metadata"), "record_id", "left").select(
        "record_id", "request", "response", "metadata"
    )


def captures(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` to archives in the shared checkpoint folder, read them back and assemble them.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``. Of responses length and digest are
    taken from the payload read, of revisits from their headers and metadata.
    """
    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes)
    found = transactions(read_archives(spark, path))
    fields = F.decode(F.col("metadata.block"), "UTF-8")

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract(fields, f"(?m)^{name}: (.*?)\r?$", 1), F.lit("")).cast("long")

    flat = found.select(
        field("page-id").alias("page_id"), field("payload-bytes").alias("told_bytes"), field("refers-to-page").alias("refers_to"),
        F.col("response.kind").alias("record_type"), F.substring_index("response.payload_digest", ":", -1).alias("told_digest"),
        F.col("response.block").alias("http"),
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema)
    read = flat.mapInArrow(_digested, f"{schema}, body_bytes long, body_digest string")
    own = F.col("record_type") == "response"
    return read.select(
        "page_id", F.when(own, F.col("body_bytes")).otherwise(F.col("told_bytes")).alias("payload_bytes"),
        F.when(own, F.col("body_digest")).otherwise(F.col("told_digest")).alias("payload_digest"), "record_type", "refers_to",
    )
