"""Seekable Zstandard bundles of WARC records.

Pages become WARC response records; records are grouped into frames that decompress on their own, and a
bundle ends in the seek table of the Zstandard seekable format (a skippable frame), so a reader finds any
frame from the end of the file, and any record from its offset inside its frame.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
LEVEL = 3
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Of records of which no time is known; equal input must give equal bytes.
DATE = "1970-01-01T00:00:00Z"
#: What a URI may hold as it is; anything else is percent-encoded, byte by byte.
_URI = set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~:/?#[]@!$&'()*+,;=%")
SCHEMA = (
    "bundle_id string, records int, frames int, raw_bytes bigint, bundle binary, "
    "index array<struct<record_id: bigint, warc_id: string, frame: int, offset: int, length: int>>"
)
_INDEX = pa.list_(pa.struct([("record_id", pa.int64()), ("warc_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))


def target_uri(url: str | None) -> str:
    """The URL with white space and whatever else no URI holds percent-encoded; white space around it is dropped."""
    return "" if url is None else "".join(chr(b) if b in _URI else f"%{b:02X}" for b in url.strip().encode("utf-8"))


def record(page_id: int | None, url: str | None, html: str | None, date: str | None = None) -> tuple[str, bytes]:
    """The WARC-Record-ID and the bytes of one record.  The id follows from the content.  date: as WARC has it, of the crawl."""
    body = b"" if html is None else html.encode("utf-8")
    target = target_uri(url)
    digest = hashlib.sha1(body).digest()
    ident = uuid.UUID(bytes=hashlib.sha1(repr((page_id, url, html is None)).encode() + digest).digest()[:16], version=5)
    lines = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{ident}>", f"WARC-Date: {date or DATE}"]
    if target:
        lines.append(f"WARC-Target-URI: {target}")
    lines += [f"WARC-Payload-Digest: sha1:{digest.hex()}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return str(ident), "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of these compressed and raw sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """Of each frame: where it starts, its compressed and its raw size."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    at, start, out = len(bundle) - 9 - entry * count, 0, []
    for k in range(count):
        size, raw = struct.unpack_from("<II", bundle, at + entry * k)
        out.append((start, size, raw))
        start += size
    return out


def read_record(bundle: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record; only its frame is decompressed."""
    start, size, raw = read_seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + size], max_output_size=raw)[offset : offset + length]


class _Bundle:
    def __init__(self, frame_bytes: int, level: int) -> None:
        self.frame_bytes, self.coder = frame_bytes, zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True)
        self.done: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.filled = self.raw = 0
        self.index: list[dict] = []

    def add(self, page_id: int | None, url: str | None, html: str | None, date: str | None = None) -> None:
        ident, data = record(page_id, url, html, date)
        if self.filled and self.filled + len(data) > self.frame_bytes:
            self.close_frame()
        self.index.append({"record_id": page_id, "warc_id": ident, "frame": len(self.done), "offset": self.filled, "length": len(data)})
        self.open.append(data)
        self.filled += len(data)
        self.raw += len(data)

    def close_frame(self) -> None:
        if self.open:
            packed = self.coder.compress(b"".join(self.open))
            self.done.append(packed)
            self.sizes.append((len(packed), self.filled))
            self.open, self.filled = [], 0

    def finish(self) -> pa.RecordBatch:
        self.close_frame()
        data = b"".join(self.done) + seek_table(self.sizes)
        columns = [
            pa.array([hashlib.sha256(data).hexdigest()[:32]]),
            pa.array([len(self.index)], pa.int32()),
            pa.array([len(self.done)], pa.int32()),
            pa.array([self.raw], pa.int64()),
            pa.array([data], pa.binary()),
            pa.array([self.index], _INDEX),
        ]
        return pa.RecordBatch.from_arrays(columns, ["bundle_id", "records", "frames", "raw_bytes", "bundle", "index"])


def bundles(pages: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL, date: str | None = None) -> DataFrame:
    """One row per bundle: bundle_id (of its content), records, frames, raw_bytes, bundle (the file) and index.

    index maps each record_id (page_id) to its frame and to its offset and length in the raw frame.  Records
    are bundled in the order in which they are read, within each input split: no shuffle.  A null html is an
    empty body, a null url no target, a null page_id a null record_id; repeated rows are repeated records; a
    record longer than a frame has a frame of its own; an empty table has no bundles.  date: the column with the time of
    the crawl, if there is one; without it, and where it is null, records are of DATE.  Other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = _Bundle(frame_bytes, level)
        for batch in batches:
            ids, urls, bodies, dates = (batch.column(c) for c in ("page_id", "url", "html", "date"))
            for i in range(batch.num_rows):
                bundle.add(ids[i].as_py(), urls[i].as_py(), bodies[i].as_py(), dates[i].as_py())
                if bundle.raw >= bundle_bytes:
                    yield bundle.finish()
                    bundle = _Bundle(frame_bytes, level)
        if bundle.index:
            yield bundle.finish()

    when = F.lit(None).cast("string") if date is None else F.date_format(F.to_utc_timestamp(F.col(date).cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", when.alias("date")).mapInArrow(run, SCHEMA)


def locate(bundled: DataFrame) -> DataFrame:
    """record_id, warc_id, bundle_id, frame, offset, length of each record; none of a table without bundles."""
    return bundled.select("bundle_id", F.explode("index").alias("at")).select("at.record_id", "at.warc_id", "bundle_id", "at.frame", "at.offset", "at.length")


def extract(bundled: DataFrame) -> DataFrame:
    """record_id, warc_id and raw record of every bundle, read back through the seek table; a null record_id stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cached: tuple[int, bytes] = (-1, b"")
                frames, coder, out = read_seek_table(row["bundle"]), zstandard.ZstdDecompressor(), []
                for e in row["index"]:
                    if cached[0] != e["frame"]:
                        start, size, raw = frames[e["frame"]]
                        cached = (e["frame"], coder.decompress(row["bundle"][start : start + size], max_output_size=raw))
                    out.append(cached[1][e["offset"] : e["offset"] + e["length"]])
                columns = [pa.array([e["record_id"] for e in row["index"]], pa.int64()), pa.array([e["warc_id"] for e in row["index"]]), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["record_id", "warc_id", "record"])

    return bundled.mapInArrow(run, "record_id bigint, warc_id string, record binary")
