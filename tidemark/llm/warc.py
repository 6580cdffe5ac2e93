"""Legacy archives: ARC files written, converted to WARC, and read back.

An ARC file starts with a version block whose second line names its version and whose third names
the fields of every header line; the converter goes by them. Records are cut by their declared
lengths alone, so a payload may hold anything. From the header line and the HTTP head it makes the
WARC date, type and digests, and an identifier: a name-based UUID of the page's URI, date, digest and,
where it has one, page id. Page ids travel in a header of their own (``X-Page-Id``), which archives
of other makers lack; their records convert alike and have a null page_id. Of records with equal
payloads the one with the largest page id is a response and the others are revisits of it, stored
without payload; records without a page id refer to nothing among themselves.

All files pass through Spark's own readers and writers, so any file system that Spark knows will
do; a task holds one archive file (at most ``records_per_file`` records) at a time.

Edge cases: a null html is an empty payload; empty payloads revisit each other like any others. A
null url becomes ``urn:none``, white space in urls is escaped. Rows with a null page_id are
archived, count as older than any other and are responses only where no other page has their
payload. Repeated rows with the largest page_id are all responses. An empty table gives no
records. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.storage import Workspace, shuffle_cleanup

# The header fields of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED = "20240101000000"
RECORDS_PER_FILE = 2048
RECORD = "page_id long, url string, date string, media_type string, payload binary, payload_bytes long, payload_digest string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writing legacy archives ---------------------------------------------------------------------


def version_block(version: int) -> bytes:
    body = f"{version} 0 tidemark\n{ARC_FIELDS[version]}\n\n"
    tail = f"200 - - 0 tidemark.arc {len(body)}" if version == 2 else str(len(body))
    return f"filedesc://tidemark.arc 0.0.0.0 {CAPTURED} text/plain {tail}\n{body}".encode()


def arc_record(version: int, page_id: int | None, url: str | None, html: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {page_id}\r\n\r\n".encode()
    where = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    size = len(head) + len(html)
    tail = f"200 {digest(html)} - 0 tidemark.arc {size}" if version == 2 else str(size)
    return f"{where} 0.0.0.0 {CAPTURED} text/html {tail}\n".encode() + head + html


def write_arc(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes page_id, url and html as gzipped ARC files, alternately of both versions."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        version = 1 + part % 2
        for batch in rows:
            out = []
            for page_id, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html"))):
                if n % records_per_file == 0:
                    version = 1 + (part + n // records_per_file) % 2
                    out.append(version_block(version))
                    n += 1
                out.append(arc_record(version, page_id.as_py(), url.as_py(), (html.as_py() or "").encode()))
                n += 1
            # The payloads are UTF-8 text, so a record is a valid string.
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    records = rows.mapInArrow(batches, "value string")
    records.write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


# --- reading and converting ----------------------------------------------------------------------


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and body of each record of one archive, by declared lengths."""
    at, fields = 0, ARC_FIELDS[1].split()
    while at < len(data):
        end = data.index(b"\n", at)
        line = data[at:end].decode().split(" ")
        if not line[0]:  # the blank line between records
            at = end + 1
            continue
        size = int(line[-1])
        body = data[end + 1 : end + 1 + size]
        if len(body) < size:
            raise ValueError("the archive ends within a record")
        at = end + 1 + size
        if line[0].startswith("filedesc:"):
            fields = body.decode().split("\n")[1].split()
            continue
        if len(line) != len(fields):
            raise ValueError(f"{len(line)} header fields where the archive's version has {len(fields)}")
        yield dict(zip(fields, line)), body


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower case) and entity of an HTTP response."""
    head, _, entity = block.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])
    return {name.lower(): value.strip() for name, _, value in pairs}, entity


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """One row per archived page, with its HTTP block as payload and the digest of the entity."""

    def batches(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in files:
            for content in batch.column("content"):
                rows: list[tuple] = []
                for fields, block in arc_records(gzip.decompress(content.as_py())):
                    head, entity = split_http(block)
                    own = head.get("x-page-id", "None")
                    d = fields["Archive-date"]
                    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
                    rows.append((None if own == "None" else int(own), fields["URL"], date, fields["Content-type"], block, len(entity), digest(entity)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 7, RECORD_TYPES)], RECORD_NAMES)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(batches, RECORD)


RECORD_NAMES = [x.split(" ")[0] for x in RECORD.split(", ")]
RECORD_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()]


def record_id(url: str, date: str, payload_digest: str, page_id: int | None) -> str:
    name = f"{url} {date} {payload_digest}" + ("" if page_id is None else f" {page_id}")
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def warc_record(page_id: int | None, url: str, date: str, block: bytes, size: int, payload_digest: str, first: dict | None, revisit: bool) -> bytes:
    """A WARC record without its last line break. ``first`` (page_id, url, date) is what a revisit refers to."""
    head = block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n"
    content = head if revisit else block
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(url, date, payload_digest, page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(content)}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(content)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        of = first["url"], first["date"]
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(*of, payload_digest, first['page_id'])}", f"WARC-Refers-To-Target-URI: {of[0]}", f"WARC-Refers-To-Date: {of[1]}", f"X-Refers-To-Page-Id: {first['page_id']}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + content + b"\r\n"


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Converts ARC files to gzipped WARC files; payloads of ``least_bytes`` or more are stored once.

    Only digests are grouped; records meet the few groups with more than one member in a join that
    adaptive execution splits where a payload is very common.
    """
    space = Workspace(spark, "warc")
    records = read_arc(spark, arc_path)
    groups = records.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max(F.struct("page_id", "url", "date")).alias("first"), F.count("*").alias("n"))
    shared = space.save(groups.filter("n > 1 and first.page_id is not null").select("payload_digest", "first"), "shared")
    marked = records.join(shared, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = [warc_record(**{k: v.as_py() for k, v in zip(names, values)}) for values in zip(*batch.columns)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    names = ["page_id", "url", "date", "block", "size", "payload_digest", "first", "revisit"]
    ready = marked.select("page_id", "url", "date", "payload", "payload_bytes", "payload_digest", "first", revisit.alias("revisit")).toDF(*names)
    lines = ready.mapInArrow(batches, "value string")
    with shuffle_cleanup(spark):
        lines.write.mode("overwrite").option("compression", "gzip").option("lineSep", "\r\n").option("maxRecordsPerFile", records_per_file).text(warc_path)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] not in ("WARC/1.0", "WARC/1.1"):
            raise ValueError("not at the start of a WARC record")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (the page_id) and record_id of each record.

    A response's digest is taken from its payload again; a stored one that differs is an error.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string"
    number = lambda x: None if x is None else int(x)

    def batches(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in files:
            for content in batch.column("content"):
                rows: list[tuple] = []
                for fields, block in warc_records(gzip.decompress(content.as_py())):
                    kind, own = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(fields["X-Payload-Length"])
                    if kind == "response":
                        entity = split_http(block)[1]
                        if digest(entity) != own or len(entity) != size:
                            raise ValueError("a payload differs from its digest")
                    rows.append((number(fields.get("X-Page-Id")), size, own, kind, number(fields.get("X-Refers-To-Page-Id")), fields["WARC-Record-ID"]))
                arrays = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 6, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(batches, schema)


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages to ARC files, those to WARC files, and the WARC files read back."""
    space = Workspace(spark, "archive")
    write_arc(pages, space.path("arc"))
    convert_arc(spark, space.path("arc"), space.path("warc"))
    space.drop("arc")
    return read_warc(spark, space.path("warc"))
