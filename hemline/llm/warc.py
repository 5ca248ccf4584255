"""WARC archives: writing, reading, and revisit records in place of repeated payloads.

Archives are gzip files of at most ``PER_FILE`` records, written by Spark's text writer with the record end as line
end, so any store that Spark writes to will do. They are read as binary files and walked record by record; a task
holds one compressed file. To resolve revisits only headers are shuffled, by payload digest; the digest of a third
of all records is an ordinary aggregate and a join that adaptive execution may split. The rewrite joins records to
their decisions by file and place, and writes fresh headers.

Defined results: a null payload is empty; of records with equal payloads the one with the smallest key is the
response, null keys last, of equal keys the first in file order; payloads below ``least_bytes`` are never revisits; a
null address has no header, white space and controls in it are escaped; an empty table gives no archive and no row;
other columns never matter. Payloads are text and are stored in UTF-8.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hemline.llm.base import whole_text
from hemline.session import scratch_path, written

PER_FILE = 16_384
DATE = "2020-01-01T00:00:00Z"
END = "\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = ("file string, place long, type string, key string, uri string, payload_bytes long, payload_digest string, "
           "refers_to string")


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32: every five hex digits are four of base 32."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"))        # null without a value, and so left out


def _urn(key: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.coalesce(key, F.lit("")), digest).cast("binary"))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def write_archives(records: DataFrame, path: str, date: str = DATE, per_file: int = PER_FILE) -> None:
    """Write (type, key, uri, payload, payload_bytes, payload_digest, refers_to, refers_uri) as WARC files.

    A revisit has HTTP headers but no payload, and names the record that has it.
    """
    revisit = F.col("type") == "revisit"
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(END))
    uri = F.regexp_replace("uri", "[\\x00-\\x20\\x7F]", "%20")
    referred = F.regexp_replace("refers_uri", "[\\x00-\\x20\\x7F]", "%20")
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), _header("WARC-Type", F.col("type")), _header("WARC-Target-URI", uri),
        _header("WARC-Date", F.lit(date)), _header("WARC-Record-ID", _urn(F.col("key"), F.col("payload_digest"))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        _header("X-Record-Key", F.col("key")), _header("X-Payload-Length", F.col("payload_bytes")),
        _header("WARC-Profile", F.when(revisit, REVISIT)),
        _header("WARC-Refers-To", F.when(revisit, _urn(F.col("refers_to"), F.col("payload_digest")))),
        _header("WARC-Refers-To-Target-URI", F.when(revisit, referred)),
        _header("X-Refers-To-Key", F.when(revisit, F.col("refers_to"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        _header("Content-Length", F.octet_length(http) + F.octet_length(body)))
    (records.select(F.concat(head, F.lit(END), http, body).alias("value")).write
     .option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path))


def walk(content: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers with lower-case names, HTTP headers, payload) of each record of an archive, gzipped or plain."""
    plain = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=plain)) if content[:2] == b"\x1f\x8b" else plain
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue                                    # the empty lines after a record
        headers: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            headers[name.decode().lower()] = value.strip().decode()
        block = stream.read(int(headers.get("content-length", 0)))
        if headers.get("content-type", "").startswith("application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
            yield headers, http, payload
        else:
            yield headers, b"", block


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record: its headers, and the payload as binary if asked for.

    Length and digest are those of the payload read; a revisit has them from its headers.
    """
    schema = HEADERS + (", payload binary" if with_payload else "")
    names = [field.split()[0] for field in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(),
             pa.binary()][:len(names)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                rows, held = [], 0
                for place, (headers, _, payload) in enumerate(walk(content.as_py())):
                    if headers.get("warc-type") == "revisit":
                        size = int(headers.get("x-payload-length", 0))
                        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                    else:
                        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    rows.append((file.as_py(), place, headers.get("warc-type"), headers.get("x-record-key"),
                                 headers.get("warc-target-uri"), size, digest, headers.get("x-refers-to-key"),
                                 payload)[:len(names)])
                    held += len(payload) if with_payload else 200
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(each, schema)


def resolved(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Headers of responses with type, refers_to and refers_uri as they should be.

    ``key`` is ordered by the column ``rank``.
    """
    first = F.min(F.struct(F.col("rank").isNull().alias("unkeyed"), "rank", "file", "place", "key", "uri")).alias("first")
    repeated = (
        headers.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
        .agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1").select("payload_digest", "first")
    )
    joined = headers.drop("type", "refers_to").join(repeated, "payload_digest", "left")
    again = (F.col("payload_bytes") >= least_bytes) & F.col("first").isNotNull() & ~(
        (F.col("first.file") == F.col("file")) & (F.col("first.place") == F.col("place")))
    return joined.select(
        *[c for c in joined.columns if c != "first"], F.when(again, "revisit").otherwise("response").alias("type"),
        F.when(again, F.col("first.key")).alias("refers_to"), F.when(again, F.col("first.uri")).alias("refers_uri"))


def deduplicated_archives(pages: DataFrame, id: str = "page_id", uri: str = "url", payload: str = "html",
                          least_bytes: int = 0, source: str | None = None, target: str | None = None) -> DataFrame:
    """Write a record per row to ``source``, the deduplicated archives to ``target``, and return what these hold.

    One row per input row: id, payload_bytes, payload_digest, record_type, refers_to, uri.
    """
    spark, kind = pages.sparkSession, pages.schema[id].dataType.simpleString()
    source, target = source or scratch_path(spark, "warc"), target or scratch_path(spark, "warc-deduplicated")
    content = F.col("payload").cast("binary")
    write_archives(
        pages.select(F.lit("response").alias("type"), F.col(f"`{id}`").cast("string").alias("key"),
                     F.col(f"`{uri}`").alias("uri"), whole_text(payload).alias("payload"))
        .select("*", F.octet_length("payload").alias("payload_bytes"), base32_sha1(content).alias("payload_digest"),
                F.lit(None).cast("string").alias("refers_to"), F.lit(None).cast("string").alias("refers_uri")), source)
    headers = written(read_archives(spark, source).withColumn("rank", F.col("key").cast(kind)), "warc-headers")
    decided = resolved(headers, least_bytes).select("file", "place", "type", "refers_to", "refers_uri")
    records = read_archives(spark, source, with_payload=True).drop("type", "refers_to")
    write_archives(
        records.join(decided, ["file", "place"]).withColumn("payload", F.decode("payload", "UTF-8")), target)
    return read_archives(spark, target).select(
        F.col("key").cast(kind).alias(id), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"), "uri")
