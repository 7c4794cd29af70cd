"""WARC archives (operator 8): a writer with revisit records and a splittable reader.

The writer makes one gzip member a record. Records whose payload another record holds already
become revisits, found by digest in a shuffle that doesn't move payloads. Each task writes files
of its own under unique names and returns what it wrote; only files of tasks that ended well
are listed, so that tasks can be rerun.

The reader cuts files into byte ranges. A task looks for the gzip magic in its range, validates
each candidate by decoding its headers, and reads all records that start inside, to their ends
beyond the range if need be. Files needn't come from this writer.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_order, shared_dir, written

#: Payloads below this size are never revisits; a file is closed when it passes its size.
REVISIT_BYTES, FILE_BYTES = 100, 1 << 30
#: Bytes of a reader's range, and of one read; most reading tasks, each with as many ranges as it takes.
RANGE_BYTES, READ_BYTES, MOST_TASKS = 4 << 20, 1 << 20, 1 << 16

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LISTING, RECORD = "path string, length long, records long", "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _member(data: bytes, mark: bytes) -> bytes:
    """One gzip member; its header comment is ``mark``, the same for all members of a file."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    return MAGIC + b"\x10\0\0\0\0\0\xff" + mark + b"\0" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = "2020-01-01T00:00:00Z") -> bytes:
    """A response record, or a revisit if the payload is that of page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _record_id(page_id, digest),
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else quote(url, safe="/:?#[]@!$&'()*+,;=%-._~", errors="surrogatepass") if re.search(r"[\x00-\x20\x7f-\U0010ffff]", url) else url,
        "X-Page-URL": None if url is None else quote(url, safe="", errors="surrogatepass"),
        "X-Page-ID": page_id,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Profile": None if refers_to is None else PROFILE,
        "WARC-Refers-To": None if refers_to is None else _record_id(refers_to, digest),
        "X-Refers-To-Page": refers_to,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def planned(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_digest, refers_to): which records are written, and which as revisits."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.cast("binary").alias("payload"), F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).alias("_size"))
    first = rows.where(F.col("_size") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.min(doc_order(F.col("page_id"))).alias("_first"), F.max(doc_order(F.col("page_id"))).alias("_last")).where("_first < _last")
    joined = rows.join(first, "payload_digest", "left")
    refers = F.when(F.col("_first") < doc_order(F.col("page_id")), F.col("_first"))
    return joined.select("page_id", "url", "payload", "payload_digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes one record per row of (page_id, url, html); returns the list (path, length, records) of files.

    A null html is an empty payload; a null url or page_id is left out of the record's headers. Of
    rows with equal payloads of ``REVISIT_BYTES`` or more, those with the smallest page_id are
    responses, the others revisits of it (a missing page_id counts as largest). Repeated rows get a
    record each. Payloads of any length are written whole; one is held a few times over in its task's memory. An empty table
    gives no files. Other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, made = None, []

        def close():
            out[0].close()
            made.append((out[1], out[2], out[3]))

        for batch in batches:
            for row in zip(*(c for c in batch.columns)):
                page_id, url, payload, digest, refers = (x.as_py() for x in row)
                if out is None:
                    mark = uuid.uuid4().hex
                    name = f"records-{TaskContext.get().partitionId():06d}-{mark}.warc.gz"
                    out = [fs.open_output_stream(f"{root}/{name}", compression=None), f"{folder.rstrip('/')}/{name}", 0, 0, mark.encode()]
                data = _member(record_bytes(page_id, url, payload, digest, refers), out[4])
                out[0].write(data)
                out[2] += len(data)
                out[3] += 1
                if out[2] >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*made) if made else ([], [], []), (pa.string(), pa.int64(), pa.int64()))], names=["path", "length", "records"])

    return written(planned(pages).mapInArrow(run, LISTING))  # written once: reading the list never writes archives again


class _Source:
    """A file read forwards in pieces."""

    def __init__(self, path: str):
        fs, name = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(name)
        self.size = self.file.size()

    def at(self, offset: int, n: int = READ_BYTES) -> bytes:
        self.file.seek(offset)
        return self.file.read(min(n, max(0, self.size - offset)))


def _inflate(source: _Source, offset: int, enough=None) -> tuple[bytes, int] | None:
    """(data, end) of the gzip member at offset; None if there is none. enough: stops early when true for the data so far."""
    unpack, parts, held, at = zlib.decompressobj(31), [], 0, offset
    while not unpack.eof:
        piece = source.at(at)
        if not piece:
            return None
        try:
            parts.append(unpack.decompress(piece, 0 if enough is None else 4096))
        except zlib.error:
            return None
        at += len(piece)
        held += len(parts[-1])
        if enough is not None:
            return b"".join(parts), at
    return b"".join(parts), at - len(unpack.unused_data)


def _mark(head: bytes) -> bytes:
    """The comment in a gzip header without other optional fields, else nothing."""
    return head[10 : head.find(b"\0", 10)] if head[:4] == MAGIC + b"\x10" else b""


def members(source: _Source, begin: int, end: int) -> Iterator[bytes]:
    """The data of all WARC members that start in [begin, end).

    A candidate is a member if it decodes to a WARC header and has the comment of the file's first
    member: archives within archives aren't taken for records.
    """
    mark, at = _mark(source.at(0, 256)), begin
    while at < end:
        piece = source.at(at, min(READ_BYTES, end - at) + 2)
        k = piece.find(MAGIC)
        if k < 0:
            at += max(1, len(piece) - 2)
            continue
        at += k
        if at >= end:
            return
        # A validated member's end is where the next one starts, so the search is for the first only.
        while at < end and _mark(source.at(at, 256)) == mark and (head := _inflate(source, at, True)) and head[0].startswith(b"WARC/1."):
            found = _inflate(source, at)
            if found is None:
                break
            yield found[0]
            at = found[1]
            if source.at(at, 3) != MAGIC:
                break
        else:
            at += at < end


def parse_record(data: bytes) -> tuple | None:
    """The columns of ``RECORD`` for a response or revisit record, else None; checks the payload's digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields.get("warc-payload-digest", "").rpartition(":")[2]
    number = lambda name: int(fields[name]) if name in fields else None
    url = fields.get("x-page-url")
    url = fields.get("warc-target-uri") if url is None else unquote(url, errors="surrogatepass")
    if kind == "response":
        own = hashlib.sha256(payload).hexdigest()
        if fields.get("warc-payload-digest", "").startswith("sha256:") and own != digest:
            raise ValueError(f"payload of {fields.get('warc-record-id')} has another digest than its record says")
        return number("x-page-id"), url, len(payload), own, kind, None, payload
    sized = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    return number("x-page-id"), url, int(sized[1]) if sized else None, digest, kind, number("x-refers-to-page"), None


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files under a path or pattern, without reading them."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def read_archives(files: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """All response and revisit records of the (path, length) table of files, in the columns of ``RECORD``.

    Each range of ``range_bytes`` is a row, and a task of its own up to ``MOST_TASKS``; a file's size doesn't
    bound parallelism. The ranges are counted from the files' lengths, and dealt out by that number: as
    rows they are tiny, so that the adaptive planner would put all of them into one task. A task holds one record
    at a time, several times over (packed, unpacked, payload), and batches of about 8 MB.
    Payloads are null for revisits and where ``with_payload`` is false. A damaged payload raises. No files: no rows.
    """
    last = F.greatest(F.col("length") - 1, F.lit(0))
    cut = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(range_bytes).cast("long"))).alias("begin"))
    n_ranges = files.agg(F.sum(F.floor(last / range_bytes) + 1)).first()[0] or 0
    ranges = cut.select("path", "begin", F.least(F.col("begin") + range_bytes, F.col("length")).alias("end")).repartition(max(1, min(n_ranges, MOST_TASKS)))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in RECORD.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                for data in members(_Source(path), begin, end):
                    if (row := parse_record(data)) is None:
                        continue
                    rows.append(row if with_payload else (*row[:-1], None))
                    held += len(row[-1] or b"") * with_payload + 200
                    if held > 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return ranges.mapInArrow(run, RECORD)


def digest(pages: DataFrame) -> DataFrame:
    """Writes the pages to archives in the shared folder, reads them back, one row per record."""
    files = write_archives(pages, shared_dir(pages.sparkSession) + "-warc")
    return read_archives(files.select("path", "length"), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB form of ``digest``.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_page FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first_page < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_page < d.page_id THEN f.first_page END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""
