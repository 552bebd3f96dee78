"""Operator 9, WARC archives with an externally merged capture index.

Pages become WARC records: a response with the payload, or, where an equal
payload has been captured under a smaller page_id, a revisit that refers to it.
Every record is a gzip member of its own (several, if it has MEMBER_BYTES or
more), and an archive is a file of at most ARCHIVE_BYTES or one record. Spark's
text sink writes the files to the shared folder, so any Hadoop file system will
do: a value is an archive less its last byte, which is the highest byte of the
last member's length and so zero, and the sink's line end is that zero byte.

The archives are read back as files. Each yields a capture run, sorted by URL key
and time, with the offset and length of every record, from which `record_at`
fetches it; runs are cut by key ranges and every range merges its runs with a
loser tree, which gives one globally ordered capture index.

Defined results: null html is an empty payload; equal payloads of at least
`revisit_from` bytes are one response and revisits, smaller ones are all
responses; a row that repeats the first page_id is a response too; a null
page_id counts as the largest and refers to nothing if all are null; a null url
has an empty key; any 64-bit page_id has a date (below); captures of equal key,
time and page keep the order of their archives; a page of any length is one
record, in an archive of its own if it is larger than one; a payload that very
many pages share is split over tasks by Spark's skewed joins; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, scratch, small_batches, table, written

#: Records of at least so many payload bytes may be revisits.
REVISIT_FROM = 0
#: Compressed bytes at which an archive is closed.
ARCHIVE_BYTES = 8_000_000
#: A member's length must leave its highest byte zero.
MEMBER_BYTES = 1 << 24
#: Compressed bytes given to the inflater at once (what it does not use is copied).
FEED = 1 << 15
#: Capture-index entries merged by one task.
ENTRIES_PER_RANGE = 200_000
#: The pages carry no capture time: page n counts as captured n modulo SPAN seconds after this.
EPOCH, SPAN = datetime(2024, 1, 1, tzinfo=timezone.utc), 1 << 31
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

CAPTURES = "archive string, offset long, length long, url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, in lower case: captures of one site sort together."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return url.lower()
    return f"{host.removesuffix(',www')}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def _line(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, html: str, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. refers_to: None for a response."""
    payload = html.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = len(http) + (len(payload) if refers_to is None else 0)
    when = EPOCH + timedelta(seconds=(page_id or 0) % SPAN)
    head = [
        "WARC/1.0",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}",
        *([f"WARC-Target-URI: {_line(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {block}",
    ]
    return b"".join(["\r\n".join(head).encode(), b"\r\n\r\n", http, payload if refers_to is None else b"", b"\r\n\r\n"])


def members(content: bytes) -> bytes:
    """A record as gzip members whose last byte is zero."""
    out = []
    for k in range(0, len(content), MEMBER_BYTES - 1):
        packer = zlib.compressobj(wbits=31)
        out += [packer.compress(content[k : k + MEMBER_BYTES - 1]), packer.flush()]
    return b"".join(out)


def records(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, header fields and block of each record of an archive, one record in memory at a time."""
    at, packed = 0, memoryview(archive)
    while at < len(packed):
        begin, content, size = at, bytearray(), None
        while size is None or len(content) < size:
            unpacker = zlib.decompressobj(wbits=31)
            while not unpacker.eof:
                if at >= len(packed):
                    raise ValueError("a gzip member is cut short")
                content += unpacker.decompress(packed[at : at + FEED])
                at = min(at + FEED, len(packed)) - len(unpacker.unused_data)
            if size is None and (end := content.find(b"\r\n\r\n")) >= 0:
                lines = content[:end].decode().split("\r\n")
                if lines[0] != "WARC/1.0":
                    raise ValueError("not a WARC record")
                fields = dict(line.split(": ", 1) for line in lines[1:])
                size = end + 4 + int(fields["Content-Length"]) + 4
        if len(content) != size or content[-4:] != b"\r\n\r\n":
            raise ValueError("a WARC record is not closed")
        yield begin, at - begin, fields, bytes(content[end + 4 : -4])


def record_at(archive: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header fields and block of the capture that the index places there."""
    return next(records(archive[offset : offset + length]))[2:]


def write_archives(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM) -> None:
    """Write the pages' records below path as *.gz archives."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # partial aggregation first, so a payload that very many pages share costs one row a task
    firsts = rows.where(F.octet_length("html") >= revisit_from).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    rows = rows.join(firsts, "digest", "left")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def archive() -> pa.RecordBatch:
            return pa.record_batch([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])

        for batch in batches:
            for k in range(batch.num_rows):
                digest, page, url, html, first = (c[k].as_py() for c in batch.columns)
                refers = None if first is None or first == page else first
                held.append(members(record(page, url, html, base64.b32encode(bytes.fromhex(digest)).decode(), refers)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    out = rows.select("digest", "page_id", "url", "html", "first_id").mapInArrow(build, "value binary")
    # a binary value keeps its bytes as a string
    out.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The capture runs (CAPTURES): each archive's captures, sorted by URL key and time."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x[10:-1]) if x and x[10:-1] else None
        for batch in batches:
            for k in range(batch.num_rows):
                name, run = batch.column(0)[k].as_py(), []
                for offset, length, fields, block in records(batch.column(1)[k].as_buffer()):
                    head, payload = block.split(b"\r\n\r\n", 1)
                    size = int(head.rsplit(b": ", 1)[1])
                    digest = fields["WARC-Payload-Digest"][5:]
                    kind = fields["WARC-Type"]
                    intact = kind == "revisit" or (len(payload) == size and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest)
                    uri = fields.get("WARC-Target-URI")
                    run.append((name, offset, length, url_key(uri), fields["WARC-Date"], number(fields["WARC-Record-ID"]), size, digest, kind, number(fields.get("WARC-Refers-To")), intact))
                run.sort(key=lambda x: (x[3], x[4], x[5] is None, x[5] or 0, x[1]))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*run, strict=True), kinds, strict=True)], names=[x.split()[0] for x in CAPTURES.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(parse, CAPTURES)


class LoserTree:
    """K-way merge of sorted runs: every inner node keeps the loser of its match, so the next winner costs log2(k) comparisons."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.loser = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._replay(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x < y or (x == y and a < b))

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if self.loser[node] == -1:
                self.loser[node] = i
                return
            if self._before(self.loser[node], i):
                self.loser[node], i = i, self.loser[node]
            node //= 2
        self.loser[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (head := self.heads[win := self.loser[0]]) is not None:
            yield head
            self.heads[win] = next(self.runs[win], None)
            self._replay(win)


def merged_index(runs: DataFrame) -> DataFrame:
    """The captures of all runs in global order of URL key, time and page: ordered within and across partitions. runs: stored."""
    parts = pieces(runs.count(), ENTRIES_PER_RANGE, 4)
    names = [x.split()[0] for x in CAPTURES.split(", ")]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        rows = rows.combine_chunks()
        keys = [rows.column(c).to_pylist() for c in ("archive", "offset", "url_key", "captured", "page_id")]
        by_run: dict[str, list[tuple]] = {}
        for i, (archive, offset, key, when, page) in enumerate(zip(*keys, strict=True)):
            by_run.setdefault(archive, []).append((key, when, page is None, page or 0, archive, offset, i))
        # the exchange may bring the pieces of a run in any order; a sorted run costs its sort one comparison an entry
        tree = LoserTree([sorted(run) for _, run in sorted(by_run.items())])
        yield from rows.take(pa.array([entry[-1] for entry in tree], pa.int64())).to_batches()

    ranged = runs.select(*names).repartitionByRange(parts, "url_key", "captured", F.col("page_id").asc_nulls_last())
    return ranged.mapInArrow(merge, CAPTURES)


def archived(pages: DataFrame, path: str | None = None, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Write the pages' archives, read them back, and return the merged capture index."""
    spark = pages.sparkSession
    small_batches(spark)
    path = path or f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, revisit_from)
    return merged_index(written(read_archives(spark, path), "capture-runs"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archived(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
