"""Operator 2: WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames followed by the seek table
of the public seekable format: a skippable frame that holds the compressed and
decompressed size of each frame and ends in a footer. A frame holds whole
records, and an index maps a record identifier to its bundle, its frame and
the offset inside the decompressed frame, so one record costs one frame.

Tasks write their own bundles to the folder that the caller names, by its URI.
The manifest (one row per record) is a Spark table, so only bundles of tasks
that succeeded are in it; a file that a lost task left behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.store import folder, stored

FRAME_BYTES = 1 << 20     # a frame is closed when it holds so many bytes
BUNDLE_BYTES = 256 << 20  # a bundle is closed when it holds so many compressed bytes
FRAMES_A_TASK = 16        # frames, about, that a task reads
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the public seekable format and of the WARC revisit profile.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER_BYTES = 9
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST_SCHEMA = "record_id string, page_id long, bundle string, frame int, offset long, length long"
RECORD_SCHEMA = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
                 "payload binary, bundle string, frame int, offset long")
_PAGE_URN = "urn:page:"


def digest(payload: bytes) -> str:
    """Base32 SHA-1, as in a WARC-Payload-Digest."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    """Identifier of a page's record; a page without an id gets a random one."""
    return f"<{_PAGE_URN}{page_id}>" if page_id is not None else f"<{uuid.uuid4().urn}>"


def record(rid: str, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", "WARC-Type: " + ("response" if refers_to is None else "revisit"), f"WARC-Record-ID: {rid}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at an offset."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at offset {at}")
    head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    body = stop + 4
    end = body + int(head["content-length"])
    return head, data[body:end], end + 4


class _Bundle:
    """One seekable file while it is written."""

    def __init__(self, base: str, level: int):
        filesystem, path = fs.FileSystem.from_uri(base)
        name = f"{uuid.uuid4().hex}.warc.zst"
        self.uri, self.out = f"{base}/{name}", filesystem.open_output_stream(f"{path}/{name}", compression=None)
        self.packer, self.sizes, self.written, self.frame = zstandard.ZstdCompressor(level=level), [], 0, bytearray()

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset) of the record."""
        where = len(self.sizes), len(self.frame)
        self.frame += data
        if len(self.frame) >= FRAME_BYTES:
            self.flush()
        return where

    def flush(self) -> None:
        if self.frame:
            packed = self.packer.compress(bytes(self.frame))
            self.out.write(packed)
            self.sizes.append((len(packed), len(self.frame)))
            self.written += len(packed)
            self.frame = bytearray()

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


def _write(base: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, rows = None, []
        for batch in batches:
            cols = (batch.column(c) for c in ("page_id", "url", "html", "refers_to"))
            for page, url, html, ref in zip(*(c.to_pylist() for c in cols), strict=True):
                if bundle is None:
                    bundle = _Bundle(base, level)
                rid = record_id(page)
                data = record(rid, url, (html or "").encode(), ref)
                frame, offset = bundle.add(data)
                rows.append((rid, page, bundle.uri, frame, offset, len(data)))
                if bundle.written >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            if bundle is None and rows:  # a row goes out only when its bundle is whole
                yield _manifest(rows)
                rows = []
        if bundle is not None:
            bundle.close()
        if rows:
            yield _manifest(rows)
    return run


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
    names = ["record_id", "page_id", "bundle", "frame", "offset", "length"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def frames(uri: str) -> list[tuple[int, int, int]]:
    """(position, compressed, decompressed bytes) of each frame, from the seek table at the file's end."""
    filesystem, path = fs.FileSystem.from_uri(uri)
    with filesystem.open_input_file(path) as f:
        end = f.size()
        n, flags, magic = struct.unpack("<IBI", f.read_at(FOOTER_BYTES, end - FOOTER_BYTES))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        width = 12 if flags & 0x80 else 8
        table = f.read_at(n * width, end - FOOTER_BYTES - n * width)
    out, at = [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", table, i * width)
        out.append((at, packed, plain))
        at += packed
    return out


def _open(uri: str, at: int, size: int) -> bytes:
    filesystem, path = fs.FileSystem.from_uri(uri)
    with filesystem.open_input_file(path) as f:
        return zstandard.ZstdDecompressor().decompress(f.read_at(size, at))


def _list_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column("bundle").to_pylist():
            found = frames(uri)
            yield pa.RecordBatch.from_pydict({"bundle": [uri] * len(found), "frame": pa.array(range(len(found)), pa.int32()),
                                              "at": pa.array([x[0] for x in found], pa.int64()), "size": pa.array([x[1] for x in found], pa.int64())})


def _row(data: bytes, at: int, uri: str, frame: int) -> tuple[tuple, int]:
    head, block, end = parse(data, at)
    cut = block.index(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in block[:cut].split(b"\r\n") if x.lower().startswith(b"content-length"))
    payload = block[cut + 4:] if head["warc-type"] == "response" else None
    said = head["warc-payload-digest"].removeprefix("sha1:")
    if payload is not None and (digest(payload) != said or len(payload) != size):
        raise ValueError(f"{head['warc-record-id']} in {uri} is damaged")
    ids = [int(x[len(_PAGE_URN) + 1:-1]) if (x or "").startswith("<" + _PAGE_URN) else None for x in (head["warc-record-id"], head.get("warc-refers-to"))]
    return (ids[0], head.get("warc-target-uri"), size, said, head["warc-type"], ids[1], payload, uri, frame, at), end


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("bundle", pa.string()),
                     ("frame", pa.int32()), ("offset", pa.int64())])


def _records(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORD, strict=True)], schema=_RECORD)


def _read_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, frame, at, size in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "at", "size")), strict=True):
            data, here, rows = _open(uri, at, size), 0, []
            while here < len(data):
                row, here = _row(data, here, uri, frame)
                rows.append(row)
            yield _records(rows)


def _read_offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held, data, table = None, b"", {}
        for uri, frame, offset in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset")), strict=True):
            if uri not in table:
                table = {uri: frames(uri)}
            if held != (uri, frame):
                held, data = (uri, frame), _open(uri, *table[uri][frame][:2])
            yield _records([_row(data, offset, uri, frame)[0]])


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): of pages with equal payloads of at least ``min_bytes``, all but the largest id refer to it.

    Only digests and ids are aggregated, with partial maxima in each task.
    """
    own = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    src = pages.withColumn("sha", own).withColumn("size", F.octet_length(F.coalesce("html", F.lit(""))))
    groups = (src.filter(F.col("size") >= min_bytes).groupBy("sha")
              .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    return (src.join(groups, "sha", "left")
            .select("page_id", "url", "html", F.when(F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first_id")), F.col("first_id")).alias("refers_to")))


def write_bundles(pages: DataFrame, base: str | None = None, min_bytes: int = 0, level: int = 3,
                  id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per page into bundles under ``base`` (default: a new shared folder); returns the index.

    Index columns: record_id, page_id, bundle, frame, offset (inside the
    decompressed frame), length.

    Nulls and edges: a null html is the empty payload; a null url leaves the
    target out; a page without an id is a response with a random identifier
    and no other page refers to it; rows that repeat the largest id of a group
    are all responses; an empty table writes no bundle; other columns are
    ignored.
    """
    base = base or folder(pages.sparkSession, "warc")
    _make(pages.sparkSession, base)
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = with_revisits(src, min_bytes).mapInArrow(_write(base, level), MANIFEST_SCHEMA)
    return stored(rows, "warc-index")


def _make(spark: SparkSession, base: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def _tasks(index: DataFrame) -> int:
    """Tasks to read the frames in: a row of a few bytes stands for a frame, so they aren't merged by bytes."""
    frames = index.select("bundle", "frame").distinct().count()
    return max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), frames // FRAMES_A_TASK)


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record of the bundles that an index names, a frame at a time, each payload checked against its digest."""
    found = index.select("bundle").distinct().mapInArrow(_list_frames, "bundle string, frame int, at long, size long")
    return found.repartition(_tasks(index), "bundle", "frame").mapInArrow(_read_frames, RECORD_SCHEMA)


def read_records(index: DataFrame, page_ids: DataFrame) -> DataFrame:
    """The records of some page ids: for each, one seek, one frame and one offset."""
    want = index.join(page_ids.select(F.col(page_ids.columns[0]).cast("long").alias("page_id")).distinct(), "page_id", "left_semi")
    return want.repartition(_tasks(index), "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(_read_offsets, RECORD_SCHEMA)
