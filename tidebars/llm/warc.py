"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is a response (or a revisit, which has no payload of its own), the request that led to it, and metadata. The latter two name the
response in WARC-Concurrent-To. Records are made by column functions and written by Spark's text writer, whose line separator is the pair of
line ends that closes a record; a file is one gzip stream of complete records. Reading streams each file through its headers and lengths.
Transactions are joined on the response's record id.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.llm.common import filled, map_arrow, shared_path, stored

#: Payloads shorter than this are always stored.
LEAST_REVISIT = 1000
#: Records in a file at most (three for each page).
FILE_RECORDS = 6000
DATE = "2024-01-01T00:00:00Z"
#: Bytes of records that the reader hands on at once.
BATCH_BYTES = 4 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_END = "\r\n"
_SCHEMA = "record_type string, record_id string, concurrent_to string, headers map<string,string>, block binary"


def _line(name: str, value: Column) -> Column:
    """A header line. Line ends inside a value would end the line, so they are percent-encoded. A null value gives no line."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), safe, F.lit(_END)))


def _record(kind: Column, record_id: Column, extra: list[Column], block: Column) -> Column:
    """A record without the two line ends that close it."""
    return F.concat(
        F.lit("WARC/1.1" + _END), _line("WARC-Type", kind), _line("WARC-Record-ID", record_id), _line("WARC-Date", F.lit(DATE)), *extra,
        _line("Content-Length", F.octet_length(block)), F.lit(_END), block)


def _urn(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def decided(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, digest (SHA-1, hex), size, and refers_to for rows that revisit another page's payload.

    Only payloads that occur twice matter; their digests are stored first, so that their size is known before they are joined."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), filled(html).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    twice = rows.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("kept_page"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(stored(twice, "repeated-payloads"), ["digest", "size"], "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("kept_page")), F.col("kept_page"))).drop("kept_page")


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT, **columns: str) -> None:
    """Request, response or revisit, and metadata of every row of ``pages``, as gzip-compressed WARC files under ``path``.

    Null html is an empty payload. Of equal payloads of ``least`` bytes or more, the row with the largest page_id is the response; equal rows
    share page_id and so are all responses. Missing urls and ids are left out of the headers.
    """
    run = F.lit(uuid.uuid4().hex)
    rows = decided(pages, least=least, **columns).withColumn("n", F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumns({k: _urn(F.lit(k), run, F.col("n")) for k in ("capture", "request", "metadata")})
    again = F.col("refers_to").isNotNull()
    uri = _line("WARC-Target-URI", F.col("url"))
    to = _line("WARC-Concurrent-To", F.col("capture"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", F.col("size")), F.lit(_END))
    response = _record(
        F.when(again, "revisit").otherwise("response"), F.col("capture"),
        [uri, F.lit("Content-Type: application/http; msgtype=response\r\n"), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), _line("WARC-Profile", F.when(again, F.lit(REVISIT_PROFILE)))],
        F.concat(head, F.when(again, F.lit("")).otherwise(F.col("payload"))))
    asked = F.concat(F.lit("GET "), F.coalesce(F.replace(F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20")), F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n"))
    request = _record(F.lit("request"), F.col("request"), [uri, to, F.lit("Content-Type: application/http; msgtype=request\r\n")], asked)
    fields = F.concat(_line("page-id", F.col("page_id")), _line("payload-length", F.col("size")), _line("refers-to-page", F.col("refers_to")))
    metadata = _record(F.lit("metadata"), F.col("metadata"), [uri, to, F.lit("Content-Type: application/warc-fields\r\n")], fields)
    out = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    out.write.option("lineSep", _END * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a file, plain or gzip with one or many members."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    stream = io.BufferedReader(stream, 1 << 20) if isinstance(stream, gzip.GzipFile) else stream
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        if not headers.get("content-length", "").isdigit():
            raise ValueError(f"record {headers.get('warc-record-id')} has no length")
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"record {headers.get('warc-record-id')} ends early")
        yield headers, block


def read_archives(spark: SparkSession, path: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """record_type, record_id, concurrent_to, headers and block of the records under ``path``, of the given kinds only if any are given."""

    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows, size = [], 0
                for headers, block in records(data.as_py()):
                    if kinds and headers.get("warc-type") not in kinds:
                        continue
                    rows.append((headers.get("warc-type"), headers.get("warc-record-id"), headers.get("warc-concurrent-to"), list(headers.items()), block))
                    size += len(block)
                    if size >= BATCH_BYTES or len(rows) >= 5000:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return map_arrow(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content"), run, _SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary())
    names = ("record_type", "record_id", "concurrent_to", "headers", "block")
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], list(names))


def transactions(spark: SparkSession, path: str) -> DataFrame:
    """One nested row for each capture: capture_id, request, response and metadata.

    A capture is a response or revisit, or an id that only requests or metadata name; parts that are missing are null. Of several requests or
    metadata records for one capture, that with the smallest record id is taken, and equal response ids are one capture. An empty archive
    gives no rows.
    """

    def side(kind: str) -> DataFrame:
        found = read_archives(spark, path, (kind,)).filter("concurrent_to is not null")
        return found.groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.min_by(F.struct("record_id", "block"), "record_id").alias(kind))

    http = F.col("block")
    cut = F.expr("position(X'0D0A0D0A', block)")
    body = F.when(cut > 0, F.substring(http, cut + 4, F.octet_length(http))).otherwise(F.lit(b""))
    answers = read_archives(spark, path, ("response", "revisit")).select(F.col("record_id").alias("capture_id"), F.struct("record_type", "headers", body.alias("payload")).alias("response"))
    # the small sides meet first, so that payloads move once
    out = answers.join(side("request").join(side("metadata"), "capture_id", "full"), "capture_id", "full")
    fields = F.map_filter(F.str_to_map(F.decode("metadata.block", "UTF-8"), F.lit(_END), F.lit(": ")), lambda k, _: k != "")
    return out.select("capture_id", "request", "response", F.when(F.col("metadata").isNotNull(), F.struct("metadata.record_id", fields.alias("fields"))).alias("metadata"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    fields, response = F.col("metadata.fields"), F.col("response")
    new = response.record_type == "response"
    return transactions(spark, path).select(
        fields["page-id"].cast("long").alias("page_id"),
        F.when(new, F.octet_length(response.payload).cast("long")).otherwise(fields["payload-length"].cast("long")).alias("payload_bytes"),
        F.when(new, F.sha1(response.payload)).otherwise(F.substring_index(response.headers["warc-payload-digest"], ":", -1)).alias("payload_digest"),
        response.record_type.alias("record_type"), fields["refers-to-page"].cast("long").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM p)
SELECT page_id, payload_bytes::bigint AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to FROM w
"""
QUERIES = {"op1_warc": (op1_warc, SQL)}
