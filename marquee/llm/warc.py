"""WARC archives: written from pages, read back, and assembled into one nested row per capture.

Writing. Every page makes a transaction of three records: the request, the response (or a revisit of an earlier response
with the same payload), and metadata. Request and metadata name the response in WARC-Concurrent-To. Of pages with equal
payloads of at least `LEAST` bytes, the one with the smallest page_id is the response; the others are revisits, hold no
payload, and name that page in WARC-Refers-To as `<urn:page:ID>`. Records end in two line ends, which is what the text writer puts
between its rows; so any store takes the archives, and a lost task leaves no half-written file behind.

Reading goes by Content-Length, so payloads may hold anything. Records meet by the response they are concurrent to.

Defined results: a null html is an empty payload; a null page_id never is the page that others revisit; rows that repeat the
smallest page_id of their payload are responses too; a null url leaves the target out. Empty tables make no captures. Only
page_id, url and html are read, other columns may have any names.
"""

import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import checkpoint_root, stored

LEAST = 100
END = "\r\n"
#: (payload bytes from, pages of one file): a file holds 256 MB of payload at most, or one larger page, so that a task can read it.
FILES = ((0, 4096), (1 << 16, 256), (1 << 20, 1))
DATE = "2026-01-01T00:00:00Z"

RECORD = ("kind STRING, record_id STRING, concurrent_to STRING, page_id LONG, target_uri STRING, refers_to LONG, "
          "content_type STRING, block_bytes LONG, payload_bytes LONG, payload_digest STRING, payload BINARY")


def _record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """The record up to its two closing line ends; headers with null values are left out."""
    lines = [F.lit(f"WARC/1.1{END}WARC-Type: {kind}{END}WARC-Date: {DATE}{END}")]
    lines += [F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)), F.lit("")) for name, value in headers]
    lines += [F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END + END), block]
    return F.concat(*lines)


def marked(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, and refers_to: the page whose payload this one repeats, else null."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
                        F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest"))
    shared = stored(rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest")
                    .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
                    .where("copies > 1 AND first IS NOT NULL").drop("copies"), "shared")
    repeats = ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(shared, "payload_digest", "left").withColumn("refers_to", F.when(repeats, F.col("first"))).drop("first")


def write_warc(pages: DataFrame, path: str, least: int = LEAST, files: tuple = FILES) -> None:
    """Gzipped archives of three records per row of `pages` (page_id, url, html) in the folder `path`. Pages are written by size, as many to
    a file as `files` says for theirs."""
    uri = F.regexp_replace("url", r"[\x00-\x20]", "%20")
    host = F.regexp_extract(uri, "^[a-zA-Z]+://([^/?#]*)", 1)
    asked = F.regexp_extract(uri, "^[a-zA-Z]+://[^/?#]*([^#]*)", 1)
    made = marked(pages, least).withColumn("capture", F.expr("uuid()"))
    name = {k: F.concat(F.lit("<urn:capture:"), F.col("capture"), F.lit(f":{k}>")) for k in ("request", "response", "metadata")}
    page = [("WARC-Page-ID", F.col("page_id")), ("WARC-Target-URI", uri)]
    payload = [("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
               ("WARC-Payload-Length", F.col("payload_bytes"))]
    answer = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
                      F.col("payload_bytes").cast("string"), F.lit(END + END))
    http = "application/http; msgtype="
    request = _record("request", [("WARC-Record-ID", name["request"]), ("WARC-Concurrent-To", name["response"]), *page,
                                  ("Content-Type", F.lit(http + "request"))],
                      F.concat(F.lit("GET "), F.when(F.coalesce(asked, F.lit("")) == "", "/").otherwise(asked),
                               F.lit(f" HTTP/1.1{END}Host: "), F.coalesce(host, F.lit("")), F.lit(END + END)))
    response = _record("response", [("WARC-Record-ID", name["response"]), *page, *payload, ("Content-Type", F.lit(http + "response"))],
                       F.concat(answer, F.col("html")))
    revisit = _record("revisit", [("WARC-Record-ID", name["response"]), *page, *payload, ("Content-Type", F.lit(http + "response")),
                                  ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                                  ("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))],
                      answer)
    metadata = _record("metadata", [("WARC-Record-ID", name["metadata"]), ("WARC-Concurrent-To", name["response"]), *page,
                                    ("Content-Type", F.lit("application/warc-fields"))],
                       F.concat(F.lit("payload-bytes: "), F.col("payload_bytes").cast("string"), F.lit(END)))
    records = F.explode(F.array(request, F.when(F.col("refers_to").isNull(), response).otherwise(revisit), metadata))
    for (size, count), (end, _) in zip(files, [*files[1:], (None, 0)]):
        mine = (F.col("payload_bytes") >= size) & (F.col("payload_bytes") < end if end else F.lit(True))
        (made.where(mine).select(records).write.mode("append").option("lineSep", END + END).option("compression", "gzip")
         .option("maxRecordsPerFile", 3 * count).text(path))


def parse(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of an archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record should begin here: {line[:80]!r}")
        headers = {}
        while head := stream.readline().rstrip(b"\r\n"):
            name, _, value = head.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"an archive ends within record {headers.get('warc-record-id')}")
        yield headers, block


def _row(headers: dict[str, str], block: bytes, payloads: bool) -> dict:
    kind = headers["warc-type"]
    page, target = headers.get("warc-page-id"), headers.get("warc-refers-to", "")
    row = {"kind": kind, "record_id": headers.get("warc-record-id"), "concurrent_to": headers.get("warc-concurrent-to"),
           "page_id": int(page) if page else None, "target_uri": headers.get("warc-target-uri"),
           "refers_to": int(target[10:-1]) if target.startswith("<urn:page:") else None, "content_type": headers.get("content-type"),
           "block_bytes": len(block), "payload_bytes": None, "payload_digest": None, "payload": None}
    if kind == "response":
        body = block.partition(b"\r\n\r\n")[2]
        row |= {"payload_bytes": len(body), "payload_digest": hashlib.sha256(body).hexdigest(), "payload": body if payloads else None}
        told = headers.get("warc-payload-digest", "")
        if told.startswith("sha256:") and told[7:] != row["payload_digest"]:
            raise ValueError(f"the payload of {row['record_id']} is not what was written")
    elif kind == "revisit":
        row |= {"payload_bytes": int(headers["warc-payload-length"]), "payload_digest": headers["warc-payload-digest"][7:]}
    return row


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of all archives in `path`, gzipped or plain. Payload size and digest of responses are taken from the
    payload that is read, those of revisits from their headers."""
    fields = pa.schema([("kind", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("page_id", pa.int64()),
                        ("target_uri", pa.string()), ("refers_to", pa.int64()), ("content_type", pa.string()),
                        ("block_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("payload", pa.binary())])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                stream = pa.BufferReader(data)
                packed = bytes(data[:2]) == b"\x1f\x8b"
                with io.BufferedReader(gzip.GzipFile(fileobj=stream) if packed else io.BytesIO(data)) as archive:
                    for headers, block in parse(archive):
                        rows.append(_row(headers, block, payloads))
                        held += len(block)
                        if len(rows) >= 5000 or held >= 1 << 24:
                            yield pa.RecordBatch.from_pylist(rows, schema=fields)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=fields)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per transaction: page_id, record_type, refers_to, payload_bytes, payload_digest, and the structs `response` (also
    for a revisit), `request` and `metadata`, null where that record is missing. Of several of a kind the last by record_id counts."""
    whole = F.struct("record_id", *[c for c in records.columns if c not in ("record_id", "concurrent_to")])
    answers = F.col("kind").isin("response", "revisit")
    by_kind = {"response": answers, "request": F.col("kind") == "request", "metadata": F.col("kind") == "metadata"}
    met = (records.where(answers | F.col("kind").isin("request", "metadata"))
           .groupBy(F.when(answers, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")).alias("capture_id"))
           .agg(*[F.max(F.when(found, whole)).alias(kind) for kind, found in by_kind.items()]))
    page = F.coalesce("response.page_id", "request.page_id", "metadata.page_id")
    return met.select(page.alias("page_id"), F.col("response.kind").alias("record_type"), "response.refers_to",
                      "response.payload_bytes", "response.payload_digest", "response", "request", "metadata")


def round_trip(pages: DataFrame) -> DataFrame:
    """Per page, from archives written and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = f"{checkpoint_root(pages.sparkSession)}/warc"
    write_warc(pages, path)
    return captures(read_records(pages.sparkSession, path, payloads=False)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
        F.col("request.target_uri").alias("requested"), F.col("metadata.block_bytes").alias("metadata_bytes"))
