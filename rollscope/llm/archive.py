"""Web archives: legacy ARC files converted to WARC.

An ARC file opens with a ``filedesc://`` block that names its version; each record is a header line
(5 fields in version 1, 10 in version 2), the declared number of bytes and a line end.  The
converter parses the header by the file's version, cuts the body by the declared length and
writes a WARC record with the equivalent identifier, timestamp, type and digests.

Files are written with Spark's text writer (gzip), one file a task, so a file is as large as an input
split (spark.sql.files.maxPartitionBytes); read back, a task unpacks one file's bytes as it goes.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollscope.llm.common import cut, scratch_path

REVISIT_FROM = 0        # payloads of at least so many bytes are revisited
# fixed values: the field lines of the two ARC versions
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
CAPTURED = "20240101000000"
_GAP = b"\r\n\r\n"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_header(version: int, url: str, date: str, mime: str, status: int, length: int, offset: int, name: str) -> str:
    fields = [url, "0.0.0.0", date, mime, str(length)]
    if version == 2:
        fields[4:4] = [str(status), "-", "-", str(offset), name]
    return " ".join(fields)


def parse_arc_header(version: int, line: str) -> dict:
    """Fields of a header line; the URL may hold blanks, so the others are taken from the right."""
    names = [n.lower() for n in ARC_FIELDS[version].split()]
    parts = line.rsplit(" ", len(names) - 1)
    if len(parts) != len(names):
        raise ValueError(f"ARC version {version} header with {len(parts)} fields: {line[:200]!r}")
    return dict(zip(names, parts))


def _url(url: str | None) -> str:
    """A URL that fits into a header line; '-' for none."""
    return urllib.parse.quote(url, safe="%/:?#[]@!$&'()*+,;=~-._") if url else "-"


def _arc_batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one ARC file: the version block, then a row for each page. Version 2 in every other file."""
    from pyspark import TaskContext
    number = TaskContext.get().partitionId()
    version, name = 1 + number % 2, f"pages-{number:05d}.arc"
    first = f"{version} 0 rollscope\n{ARC_FIELDS[version]}\n"
    head = f"filedesc://{name} 0.0.0.0 {CAPTURED} text/plain "
    head += f"200 - - 0 {name} {len(first)}" if version == 2 else str(len(first))
    block = f"{head}\n{first}"
    offset = len(block) + 1
    yield pa.RecordBatch.from_arrays([pa.array([block])], ["value"])
    for part in parts:
        for start in range(0, part.num_rows, 256):
            out = []
            for page, url, html in zip(*(part.slice(start, 256).column(i) for i in range(3))):
                body = html.as_py() or ""
                size = len(body.encode())
                who = f"X-Page-Id: {page.as_py()}\r\n" if page.is_valid else ""
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n{who}\r\n"
                line = arc_header(version, _url(url.as_py()), CAPTURED, "text/html", 200, len(http) + size, offset, name)
                out.append(f"{line}\n{http}{body}")
                offset += len(line) + 1 + len(http) + size + 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def write_arc(pages: DataFrame, path: str) -> None:
    """``pages`` (page_id, url, html) as gzip ARC files, versions 1 and 2 in turn. Null html is empty."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows.mapInArrow(_arc_batches, "value string").write.option("lineSep", "\n").option("compression", "gzip").text(path)


class _Stream:
    """Bytes of a gzip file, unpacked as they are asked for."""

    def __init__(self, packed: bytes):
        self.packed, self.at, self.buffer = packed, 0, bytearray()
        self.unpack = zlib.decompressobj(31)

    def more(self) -> bool:
        if self.at >= len(self.packed):
            return False
        chunk = self.packed[self.at:self.at + (1 << 18)]
        self.at += len(chunk)
        while chunk:
            self.buffer += self.unpack.decompress(chunk)
            chunk = self.unpack.unused_data
            if self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before the next ``mark``, which is passed; None at the end of the file."""
        start = 0
        while (i := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark))
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("archive ends within a header")
                return None
        out = bytes(self.buffer[:i])
        del self.buffer[:i + len(mark)]
        return out

    def take(self, size: int) -> bytes:
        while len(self.buffer) < size:
            if not self.more():
                raise ValueError("archive ends within a record")
        out = bytes(self.buffer[:size])
        del self.buffer[:size]
        return out


def arc_records(packed: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header fields, body) of every record of an ARC file but the version block."""
    stream = _Stream(packed)
    line = stream.until(b"\n")
    if line is None:
        return
    if not line.startswith(b"filedesc://"):
        raise ValueError("not an ARC file: no version block")
    block = stream.take(int(line.rsplit(b" ", 1)[1]))
    version = int(block.split(b" ", 1)[0])
    if version not in ARC_FIELDS:
        raise ValueError(f"unknown ARC version {version}")
    while True:
        line = stream.until(b"\n")
        if line is None:
            return
        if not line.strip():
            continue  # line ends between records
        head = parse_arc_header(version, line.decode())
        yield head, stream.take(int(head["archive-length"]))


def _http(body: bytes) -> tuple[dict, bytes, bytes]:
    """HTTP header fields, the header block, the payload."""
    i = body.find(_GAP)
    head = body[:i + 4] if i >= 0 else b""
    fields = dict(re.findall(r"(?m)^([\w-]+): *(.*?)\r?$", head.decode("latin-1")))
    return {k.lower(): v for k, v in fields.items()}, head, body[len(head):]


def _arc_read(with_block: bool):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, content in zip(part.column(0), part.column(1)):
                name = path.as_py().rsplit("/", 1)[-1]
                rows, held = [], 0
                for number, (head, body) in enumerate(arc_records(content.as_py())):
                    http, block, payload = _http(body)
                    page = http.get("x-page-id")
                    when = dt.datetime.strptime(head["archive-date"][:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
                    # the same file, place and content give the same identifier on every run
                    record = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}/{number}/{head['url']}/{sha1_base32(payload)}")
                    rows.append((f"urn:uuid:{record}", None if page is None else int(page), head["url"], head["ip-address"],
                                 when, sha1_base32(payload), len(payload), sha1_base32(body),
                                 body.decode() if with_block else None, block.decode() if with_block else None))
                    held += len(body)
                    if held > 4 << 20:
                        yield _rows_batch(rows)
                        rows, held = [], 0
                yield _rows_batch(rows)
    return batches


_ARC_SCHEMA = ("record_id string, page_id long, uri string, ip string, date string, payload_digest string, "
               "payload_bytes long, block_digest string, block string, http string")
_ARC_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(),
              pa.string(), pa.string()]


def _rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _ARC_SCHEMA.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARC_TYPES)], names)


def read_arc(spark: SparkSession, path: str, with_block: bool = True) -> DataFrame:
    """One row a record with the WARC values synthesised for it; bodies must be UTF-8 text."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_arc_read(with_block), _ARC_SCHEMA)


def _warc_batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = True
    for part in parts:
        for start in range(0, part.num_rows, 256):
            out = []
            for r in part.slice(start, 256).to_pylist():
                revisit = r["refers_id"] is not None
                block = r["http"] if revisit else r["block"]
                lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{r['record_id']}>",
                         f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['uri']}", f"WARC-IP-Address: {r['ip']}",
                         f"WARC-Payload-Digest: sha1:{r['payload_digest']}",
                         f"WARC-Block-Digest: sha1:{sha1_base32(block.encode()) if revisit else r['block_digest']}"]
                if revisit:
                    lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                              f"WARC-Refers-To: <{r['refers_id']}>"]
                lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block.encode())}"]
                out.append("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n" + block)
            if first:
                info = "software: rollscope\r\nformat: WARC File Format 1.1\r\n"
                out.insert(0, f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, out[0][:400])}>\r\n"
                              f"WARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\n"
                              f"Content-Length: {len(info)}\r\n\r\n{info}")
                first = False
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Convert the ARC files below ``arc_path`` to gzip WARC files.

    Of records with equal payloads the one with the smallest page id (then record id) is the response,
    the others are revisits that refer to it. Records without a page id come last. The decision uses
    digests only; one hot payload is one row of the table the records are joined with.
    """
    heads = cut(read_arc(spark, arc_path, with_block=False).select("record_id", "page_id", "payload_digest", "payload_bytes"), "heads")
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "record_id")
    first = (heads.where(F.col("payload_bytes") >= REVISIT_FROM).groupBy("payload_digest", "payload_bytes")
             .agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1"))
    revisits = (heads.join(first, ["payload_digest", "payload_bytes"])
                .where(F.col("record_id") != F.col("first.record_id"))
                .select("record_id", F.col("first.record_id").alias("refers_id")))
    records = read_arc(spark, arc_path).join(revisits, "record_id", "left")
    (records.mapInArrow(_warc_batches, "value string")
     .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(warc_path))


def warc_records(packed: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header fields in lower case, block) of every record of a gzip WARC file."""
    stream = _Stream(packed)
    while True:
        head = stream.until(_GAP)
        if head is None:
            return
        lines = head.decode().lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield fields, stream.take(int(fields["content-length"]))
        stream.take(4)


def _warc_read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for content in part.column(0):
            rows, held = [], 0
            for fields, block in warc_records(content.as_py()):
                if fields["warc-type"] == "warcinfo":
                    continue
                http, head, payload = _http(block)
                revisit = fields["warc-type"] == "revisit"
                page = http.get("x-page-id")
                rows.append((fields["warc-record-id"].strip("<>"), None if page is None else int(page),
                             int(http["content-length"]) if revisit else len(payload),
                             fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"],
                             fields["warc-refers-to"].strip("<>") if revisit else None, fields["warc-target-uri"],
                             fields["warc-date"], None if revisit else payload.decode()))
                held += len(block)
                if held > 4 << 20:
                    yield _warc_batch(rows)
                    rows, held = [], 0
            yield _warc_batch(rows)


_WARC_SCHEMA = ("record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, "
                "refers_id string, uri string, date string, payload string")


def _warc_batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [c.split() for c in _WARC_SCHEMA.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if t == "long" else pa.string())
                                       for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a response or revisit record of the WARC files below ``path``."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_warc_read, _WARC_SCHEMA)


def page_archive(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) as ARC, convert to WARC, read that back; one row a page.

    * Null html is an empty payload; null or odd URLs are written as '-' or percent-encoded.
    * Equal payloads, the empty one too: the smallest page_id is the response. Repeated rows are records
      of their own: one is the response, the others revisit it under the same page_id.
    * Null page_id: archived, never a response where a page with an id has the same payload.
    * Payloads are whole, however long; other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc)
    arc_to_warc(spark, arc, warc)
    return read_warc(spark, warc)


def archive_digest(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page_id of the response)."""
    records = cut(records.drop("payload"), "records")
    response = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"),
                                                                F.col("page_id").alias("refers_to"))
    return records.join(response, "refers_id", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
