"""WARC archives: writing with revisits and segments, reading with segment reassembly.

Writing. Each page gives one record. Of pages with equal payloads of at least
REVISIT_BYTES bytes the one with the smallest page_id is a response and the
others are revisits without payload; the choice is made on digests alone. A
response's block is an HTTP message with chunked transfer framing; a block
longer than ``segment_bytes`` is split into a first record and continuation
records. Records are written by Spark's text writer, whose line separator is
the end mark of a WARC record (two CRLF), so files are committed like any
table's, in any store that Spark can write.

Reading. Files are parsed record by record, by Content-Length. Complete records
are decoded in the task that reads them; only segments are shuffled, grouped by
the identifier of their origin record, ordered by segment number, and checked
against the total length. The transfer framing is decoded and the payload is
checked against its digest.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import batch, materialize, raw, work_path

REVISIT_BYTES = 100
SEGMENT_BYTES, CHUNK_BYTES, RECORDS_PER_FILE = 16384, 4096, 2000
DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Payload with chunked transfer framing."""
    out = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        out += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(framed) < at + size + 2 or framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(framed[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, _, body = block.partition(_END)
    names = {line.split(b":", 1)[0].strip().lower(): line.split(b":", 1)[1].strip().lower() for line in head.split(b"\r\n")[1:] if b":" in line}
    return unchunked(body) if names.get(b"transfer-encoding") == b"chunked" else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A WARC record without its end mark."""
    lines = ["WARC/1.1"] + [f"{k}: {str(v).translate({10: ' ', 13: ' '})}" for k, v in fields if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + _END + block


def page_records(uid: str, page_id, url, payload: bytes, digest: str, refers_to, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page."""
    name = f"<urn:x-page:{'' if page_id is None else page_id}:{uid}>"
    common = [("WARC-Target-URI", url or "urn:x-none"), ("WARC-Date", DATE)]
    about = [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", len(payload))]
    if refers_to is not None:
        yield record(
            [("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, *about, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")], b""
        )
        return
    block = _HTTP + chunked(payload)
    pieces = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    first = [("WARC-Segment-Number", 1)] if len(pieces) > 1 else []
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", name), *common, *about, ("Content-Type", "application/http;msgtype=response"), *first], pieces[0])
    for k, piece in enumerate(pieces[1:], 2):
        total = [("WARC-Segment-Total-Length", len(block))] if k == len(pieces) else []
        yield record(
            [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{k}>"), *common, ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k), *total], piece
        )


def _writer(segment_bytes: int):
    schema = pa.schema([("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for b in batches:
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)
            out, held = [], 0
            for page_id, url, html, digest, refers_to in rows:
                for r in page_records(f"{part}-{k}", page_id, url, html, digest, refers_to, segment_bytes):
                    out.append(r)
                    held += len(r)
                k += 1
                if held > 8_000_000:
                    yield batch(schema, out)
                    out, held = [], 0
            yield batch(schema, out)

    return run


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write a record for each page row to gzip files under path.

    A null html is an empty payload, a null url a placeholder. Rows that repeat
    the smallest page_id of a payload are all responses; a null page_id is never referred to.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html"))
    groups = rows.where(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.where("n > 1").select("digest", "first_id"), "payload-groups")
    joined = rows.join(groups, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")).alias("refers_to")
    )
    records = joined.mapInArrow(_writer(segment_bytes), "value binary").select(F.col("value").cast("string"))
    records.write.option("lineSep", _END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record of an uncompressed stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.partition(b":")
            fields[name.decode().strip().lower()] = value.decode().strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record ends early")
        yield fields, block


_PAGE_NAME = re.compile(r"<urn:x-page:(-?\d+)[:>]")


def _page(name: str | None) -> int | None:
    """The page number in a record's identifier; null in those of other writers."""
    m = _PAGE_NAME.match(name or "")
    return int(m[1]) if m else None


def _whole_number(text: str | None) -> int | None:
    return int(text) if text else None


_FOUND = pa.schema(
    [
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary()),
    ]
)
_FOUND_DDL = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "origin string, number int, total long, block binary"
)


def _checked(block: bytes, claimed: str | None) -> tuple[int, str]:
    payload = payload_of(block)
    digest = hashlib.sha256(payload).hexdigest()
    if claimed and claimed != digest:
        raise ValueError("a payload does not match its digest")
    return len(payload), digest


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            rows: list[tuple] = []
            held = 0
            for fields, block in parse(gzip.GzipFile(fileobj=io.BytesIO(b.column(0)[k].as_py()))):
                kind, name = fields["warc-type"], fields["warc-record-id"]
                digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
                if kind == "revisit":
                    rows.append((_page(name), _whole_number(fields.get("x-payload-length")), digest, kind, _page(fields.get("warc-refers-to")), None, None, None, None))
                elif kind == "continuation" or "warc-segment-number" in fields:
                    total = _whole_number(fields.get("warc-segment-total-length"))
                    origin = fields.get("warc-segment-origin-id", name)
                    rows.append((_page(origin), None, digest, "response", None, origin, int(fields["warc-segment-number"]), total, block))
                    held += len(block)
                elif kind == "response":
                    rows.append((_page(name), *_checked(block, digest), kind, None, None, None, None, None))
                if held > 8_000_000:
                    yield batch(_FOUND, *map(list, zip(*rows, strict=True)))
                    rows, held = [], 0
            if rows:
                yield batch(_FOUND, *map(list, zip(*rows, strict=True)))


_PAGE = pa.schema(list(_FOUND)[:5])
_PAGE_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records of rows (segments in order)."""
    for b in batches:
        rows = []
        for k in range(b.num_rows):
            segments = b.column(0)[k].as_py()
            block = b"".join(s["block"] for s in segments)
            if [s["number"] for s in segments] != list(range(1, len(segments) + 1)) or segments[-1]["total"] != len(block):
                raise ValueError("segments are missing or their lengths do not add up")
            rows.append((segments[0]["page_id"], *_checked(block, segments[0]["payload_digest"]), "response", None))
        if rows:
            yield batch(_PAGE, *map(list, zip(*rows, strict=True)))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record, with segments put together.

    Records of other writers have no page number, and their revisits no payload size; both are null then.
    """
    files = spark.read.format("binaryFile").load(f"{path}/part-*").select("content")
    found = materialize(files.mapInArrow(_read, _FOUND_DDL), "records")
    whole = found.where("origin IS NULL").select(*_PAGE.names)
    parts = found.where("origin IS NOT NULL").groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("number", "total", "page_id", "payload_digest", "block"))).alias("segments")
    )
    return whole.unionByName(parts.select("segments").mapInArrow(_assemble, _PAGE_DDL))


def round_trip(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write pages to new archives in the shared folder and report what reading them gives; an empty table gives no rows."""
    path = work_path(pages.sparkSession, "warc")
    write_archives(pages, path, segment_bytes)
    return read_archives(pages.sparkSession, path)
