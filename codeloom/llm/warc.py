"""Web archives: writing pages as WARC records, reading archives, reassembling segmented records.

A page is a ``response`` record whose block is an HTTP response with chunked
transfer framing, or a ``revisit`` of the record with the same payload. A block
over ``SEGMENT`` bytes is cut: the first record has WARC-Segment-Number 1, its
``continuation`` records name it in WARC-Segment-Origin-ID, and the last one
has WARC-Segment-Total-Length.

Archives are gzip files below the shared folder, written and read by Spark's
text source with the blank line between records as line separator, so any
store that Spark reads will do. A gzip file is one stream to one task, which
parses it by Content-Length while holding one record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, small_batches, stage

SEGMENT = 16_384
CHUNK = 4_096
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 0
_SEP = b"\r\n\r\n"
_SPACE = uuid.UUID("6f1c7a0e-6a1b-4b7e-9a57-0a4f4d1f2c11")
_DATE = "2024-01-01T00:00:00Z"


def _b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, row: str = "") -> str:
    """The record of a page; a row that has no id is told apart by its place."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page {page_id}' if page_id is not None else f'row {row}')}>"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing (RFC 9112, 7.1)."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped. Raises ValueError when it is cut short."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        at = end + 2
        if at + size + 2 > len(body) or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        parts.append(body[at : at + size])
        at += size + 2


def _fields(pairs: list[tuple[str, object]]) -> bytes:
    """Header lines; characters that would end a line are escaped."""
    lines = [f"{k}: {str(v).encode('unicode_escape').decode() if any(c in str(v) for c in chr(13) + chr(10)) else v}" for k, v in pairs]
    return ("WARC/1.1\r\n" + "\r\n".join(lines)).encode()


def _page_records(page_id: int | None, url: str | None, payload: bytes, first: int | None, row: str) -> Iterator[bytes]:
    name, digest = record_id(page_id, row), f"sha1:{_b32(payload)}"
    common = [("WARC-Date", _DATE), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    own = [("X-Page-Id", "" if page_id is None else page_id), ("X-Row", row)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if first is not None:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload)
        refers = [("WARC-Refers-To", record_id(first)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", first)]
        yield _fields([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, *refers, *own, ("Content-Length", len(block))]) + _SEP + block
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    cuts = range(0, len(block), SEGMENT)
    for number, at in enumerate(cuts, 1):
        part = block[at : at + SEGMENT]
        segment = [("WARC-Segment-Number", number)] if len(cuts) > 1 else []
        if number == 1:
            head = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common]
        else:
            head = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, f'{name} {row} {number}')}>"), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", name)]
            segment += [("WARC-Segment-Total-Length", len(block))] if number == len(cuts) else []
        yield _fields([*head, *segment, *own, ("Content-Length", len(part))]) + _SEP + part


def _writer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, count = TaskContext.get().partitionId(), 0
    for batch in batches:
        out = []
        for page_id, url, html, first in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            out.extend(_page_records(page_id, url, (html or "").encode(), first, f"{task}-{count}"))
            count += 1
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """Write one record set per row of ``pages`` (page_id, url, html) as .warc.gz text files below ``path``.

    Of the rows with equal payloads of ``least`` bytes or more, those with the
    smallest page_id are responses and the others revisit it.
    """
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    digest = F.unhex(F.sha1(F.col("html").cast("binary")))
    repeated = pages.where(F.octet_length("html") >= least).groupBy(digest.alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # Staged: its true size decides whether it is broadcast; else both sides are shuffled and a hot digest is split.
    repeated = stage(repeated.where("n > 1 and first is not null").select("digest", "first"), "repeated")
    dealt = pages.withColumn("digest", digest).join(repeated, "digest", "left")
    revisits = F.when(F.coalesce(F.col("page_id") != F.col("first"), F.lit(True)), F.col("first"))
    records = dealt.select("page_id", "url", "html", revisits.alias("first")).mapInArrow(_writer, "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", _SEP.decode()).option("compression", "gzip").text(path)


class Parser:
    """Turns the pieces of one archive between blank lines into (headers, block) records, holding one at a time."""

    def __init__(self) -> None:
        self.head: dict[str, str] | None = None
        self.parts: list[bytes] = []
        self.have, self.need = 0, 0

    def _keep(self, data: bytes) -> None:
        self.parts, self.have = [data], len(data)

    def feed(self, piece: bytes) -> list[tuple[dict[str, str], bytes]]:
        done = []
        self.parts += (piece, _SEP)
        self.have += len(piece) + len(_SEP)
        while True:
            if self.head is None:
                data = b"".join(self.parts).lstrip(b"\r\n")
                lines, found, rest = data.partition(_SEP)
                self._keep(data)
                if not found:
                    return done
                version, *fields = lines.decode("utf-8", "replace").split("\r\n")
                if not version.startswith("WARC/"):
                    raise ValueError(f"not a WARC record: {version[:40]!r}")
                self.head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in fields)}
                self.need = int(self.head["content-length"])
                self._keep(rest)
            if self.have < self.need:
                return done
            data = b"".join(self.parts)
            done.append((self.head, data[: self.need]))
            self.head = None
            self._keep(data[self.need :])

    @property
    def inside(self) -> bool:
        """Whether the archive would end within a record here."""
        return self.head is not None or bool(b"".join(self.parts).strip(b"\r\n"))


def payload_of(block: bytes) -> bytes:
    """The entity of an HTTP response block, without chunked framing."""
    head, _, body = block.partition(_SEP)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _page(head: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a whole response or revisit."""
    page = int(head["x-page-id"]) if head.get("x-page-id") else None
    said = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if head["warc-type"] == "revisit":
        fields = dict(x.lower().split(b":", 1) for x in block.split(b"\r\n")[1:] if b":" in x)
        return page, int(fields[b"content-length"]), said, "revisit", int(head["x-refers-to-page-id"])
    payload = payload_of(block)
    if said and said != _b32(payload):
        raise ValueError(f"the payload of {head.get('warc-record-id')} does not have its digest")
    return page, len(payload), said or _b32(payload), "response", None


_PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_PAGE_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
_PART = "origin string, number int, total long, page_id long, digest string, block binary"
_PART_KINDS = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary())


def _batch(rows: list[tuple], kinds: tuple, schema: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[dict[str, str], bytes]]]:
    parser, at = Parser(), None
    for batch in batches:
        got = []
        for piece, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if file != at:
                if parser.inside:
                    raise ValueError(f"{at} ends within a record")
                parser, at = Parser(), file
            got.extend(parser.feed(piece))
        yield got
    if parser.inside:
        raise ValueError(f"{at} ends within a record")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in _records(batches):
        yield _batch([_page(h, b) for h, b in got if h["warc-type"] in ("response", "revisit") and "warc-segment-number" not in h], _PAGE_KINDS, _PAGE)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in _records(batches):
        rows = []
        for h, b in got:
            if "warc-segment-number" in h:
                origin = (h.get("warc-segment-origin-id") or h["warc-record-id"]) + " " + h.get("x-row", "")
                page = int(h["x-page-id"]) if h.get("x-page-id") else None
                rows.append((origin, int(h["warc-segment-number"]), int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, page, h.get("warc-payload-digest"), b))
        yield _batch(rows, _PART_KINDS, _PART)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by origin and number to pages."""
    origin, parts = None, []

    def finish() -> tuple:
        numbers = [p[0] for p in parts]
        block, total = b"".join(p[4] for p in parts), parts[-1][1]
        if numbers != list(range(1, len(parts) + 1)) or total != len(block):
            raise ValueError(f"{origin}: segments {numbers} of {len(block)} bytes; the last one says {total}")
        head = {"warc-type": "response", "warc-record-id": origin, "x-page-id": "" if parts[0][2] is None else str(parts[0][2]), "warc-payload-digest": parts[0][3] or ""}
        return _page(head, block)

    for batch in batches:
        done = []
        for name, *part in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if name != origin and parts:
                done.append(finish())
                parts = []
            origin = name
            if not parts or parts[-1][0] != part[0]:  # a segment that is there twice counts once
                parts.append(part)
        yield _batch(done, _PAGE_KINDS, _PAGE)
    if parts:
        yield _batch([finish()], _PAGE_KINDS, _PAGE)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Pages of the archives below ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Only segmented records are shuffled, by the id of their first record.
    Raises where a block, a segment's number, a total length or a digest is
    not as stated.
    """
    small_batches(spark)
    pieces = spark.read.option("lineSep", _SEP.decode()).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    segments = pieces.mapInArrow(_segments, _PART).repartition("origin").sortWithinPartitions("origin", "number")
    return pieces.mapInArrow(_whole, _PAGE).unionByName(segments.mapInArrow(_joined, _PAGE))


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives and read them back: one row per row of ``pages``.

    Null html: an empty payload. Null url: an empty target. Null page_id: the
    row is a response, or revisits the smallest page_id with its payload. Rows
    that repeat the smallest page_id are all responses. Other columns are
    ignored. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path)
