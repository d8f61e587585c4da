"""Media columns: signature sniffing.

One Aho-Corasick pass over a value locates the magic bytes of all formats at once; a validator per format then
walks the structure from there and says how long the object is, or that there is none.  What starts at offset 0
is the value's true type, which corrects the declared one; what starts later is embedded media to be carved.

Validators read a value where it lies and decompress streams into a bounded buffer that is thrown away: memory
follows the value, not what it expands to.
"""

from __future__ import annotations

import bz2
import lzma
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Length = int | None
#: Bytes that a stream is decompressed to at a time.
OUTPUT = 1 << 18
#: Of the value at hand: where the local headers of an archive end, and where its directory does.
_headers: dict[int, int] = {}
_directories: dict[int, int] = {}


def _png(b: memoryview, at: int) -> Length:
    p = at + 8
    first = True
    while p + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, p)
        end = p + 12 + size
        if end > len(b) or (first and (kind != b"IHDR" or size != 13)):
            return None
        if zlib.crc32(b[p + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end - at
        first, p = False, end
    return None


def _gif(b: memoryview, at: int) -> Length:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return p + 1 - at
        if kind == 0x2C and p + 10 < len(b):
            flags = b[p + 9]
            p += 10 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0) + 1
        elif kind == 0x21:
            p += 2
        else:
            return None
        while p < len(b) and b[p]:
            p += b[p] + 1
        p += 1
    return None


def _jpeg(b: memoryview, at: int) -> Length:
    p, frame = at + 2, False
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return None
        kind = b[p + 1]
        if kind == 0xD9:
            return p + 2 - at if frame else None
        if kind in (0x00, 0xFF) or 0xD0 <= kind <= 0xD8:
            return None
        size = struct.unpack_from(">H", b, p + 2)[0]
        if size < 2:
            return None
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + size
        if kind == 0xDA:  # entropy-coded data runs to the next marker that is no restart
            while True:
                p = b.obj.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] == 0xD9:
                    return p + 2 - at if frame else None
                if b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
    return None


def _bmp(b: memoryview, at: int) -> Length:
    if at + 30 > len(b):
        return None
    size, reserved, data, header = struct.unpack_from("<IIII", b, at + 2)
    planes, depth = struct.unpack_from("<HH", b, at + 26)
    good = reserved == 0 and header in (40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and 14 + header <= data <= size
    return size if good and at + size <= len(b) else None


def _riff(kind: bytes) -> Callable[[memoryview, int], Length]:
    def length(b: memoryview, at: int) -> Length:
        if at + 20 > len(b) or bytes(b[at + 8 : at + 12]) != kind:
            return None
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        p = at + 12
        while p + 8 <= end <= len(b):
            p += 8 + (struct.unpack_from("<I", b, p + 4)[0] + 1 & ~1)
        return end - at if p in (end, end + 1) else None

    return length


def _pdf(b: memoryview, at: int) -> Length:
    if not b.obj[at + 5 : at + 6].isdigit():
        return None
    # it ends at its own mark, before the next header
    other = b.obj.find(b"%PDF-", at + 5)
    end = b.obj.rfind(b"%%EOF", at, other if other >= 0 else len(b))
    return end + 5 - at if end >= 0 and b.obj.rfind(b"startxref", at, end) >= 0 else None


def _zip(b: memoryview, at: int) -> Length:
    p, passed = at, []
    while p not in _headers and p + 30 <= len(b) and b[p : p + 4] == b"PK\x03\x04":
        flags = struct.unpack_from("<H", b, p + 6)[0]
        size, _, name, extra = struct.unpack_from("<IIHH", b, p + 18)
        passed.append(p)
        if flags & 8:  # sizes come after the data: look for the directory, up to which every header leads to the same one
            end = b.obj.find(b"PK\x01\x02", p)
            if end >= 0:
                q = p
                while 0 <= (q := b.obj.find(b"PK\x03\x04", q + 4, end)):
                    if b[q + 6] & 8:
                        passed.append(q)
            p = end
            break
        p += 30 + name + extra + size
    start = _headers.get(p, p)
    _headers.update(dict.fromkeys(passed, start))
    if start < 0:
        return None
    if start not in _directories:
        p = start
        while p + 46 <= len(b) and b[p : p + 4] == b"PK\x01\x02":
            p += 46 + sum(struct.unpack_from("<HHH", b, p + 28))
        _directories[start] = p
    p = _directories[start]
    if p + 22 > len(b) or b[p : p + 4] != b"PK\x05\x06":
        return None
    directory, offset, comment = struct.unpack_from("<IIH", b, p + 12)
    return p + 22 + comment - at if directory == p - start and offset == start - at and p + 22 + comment <= len(b) else None


def _stream(make: Callable[[], object]) -> Callable[[memoryview, int], Length]:
    def length(b: memoryview, at: int) -> Length:
        coder, p, step = make(), at, b""
        try:
            while not coder.eof:
                waiting = step or not getattr(coder, "needs_input", True)
                if not waiting and p < len(b):
                    step = b[p : p + (1 << 16)]
                    p += len(step)
                out = coder.decompress(step, OUTPUT)
                if not out and not waiting and not step and not coder.eof:
                    return None  # it ends too soon
                step = getattr(coder, "unconsumed_tail", b"")
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            return None
        return p - len(coder.unused_data) - at

    return length


def _ogg(b: memoryview, at: int) -> Length:
    if at and at + 27 <= len(b) and not b[at + 5] & 2 and (b[at + 5] & 1 or any(b[at + 18 : at + 22])):
        return None  # a later page of a stream, not its beginning
    p, pages = at, 0
    while p + 27 <= len(b) and bytes(b[p : p + 5]) == b"OggS\0":
        table = b[p + 26]
        if p + 27 + table > len(b):
            return None
        end = p + 27 + table + sum(b[p + 27 : p + 27 + table])
        if end > len(b):
            return None
        pages, last, p = pages + 1, b[p + 5] & 4, end
        if last:
            return p - at
    return None


def _mp4(b: memoryview, at: int) -> Length:
    p, kinds = at, set()
    while p + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, p)
        if kind not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"moof", b"mfra", b"meta", b"sidx", b"styp", b"uuid", b"udta"):
            break
        if size == 1 and p + 16 <= len(b):
            size = struct.unpack_from(">Q", b, p + 8)[0]
        if size < 8 or p + size > len(b):
            return None
        kinds.add(kind)
        p += size
    return p - at if b"ftyp" in kinds and kinds & {b"moov", b"moof", b"mdat", b"meta"} else None


#: type -> (magic bytes, their place in the object, validator)
FORMATS: list[tuple[str, bytes, int, Callable[[memoryview, int], Length]]] = [
    ("image/png", b"\x89PNG\r\n\x1a\n", 0, _png),
    ("image/gif", b"GIF87a", 0, _gif),
    ("image/gif", b"GIF89a", 0, _gif),
    ("image/jpeg", b"\xff\xd8\xff", 0, _jpeg),
    ("image/bmp", b"BM", 0, _bmp),
    ("image/webp", b"RIFF", 0, _riff(b"WEBP")),
    ("audio/wav", b"RIFF", 0, _riff(b"WAVE")),
    ("video/avi", b"RIFF", 0, _riff(b"AVI ")),
    ("application/pdf", b"%PDF-", 0, _pdf),
    ("application/zip", b"PK\x03\x04", 0, _zip),
    ("application/gzip", b"\x1f\x8b\x08", 0, _stream(lambda: zlib.decompressobj(31))),
    ("application/x-bzip2", b"BZh", 0, _stream(bz2.BZ2Decompressor)),
    ("application/x-xz", b"\xfd7zXZ\0", 0, _stream(lzma.LZMADecompressor)),
    ("audio/ogg", b"OggS\0", 0, _ogg),
    ("video/mp4", b"ftyp", 4, _mp4),
]


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    found: dict[str, list[int]] = {}
    for k, (_, magic, _, _) in enumerate(FORMATS):
        found.setdefault(magic.decode("latin-1"), []).append(k)
    automaton = ahocorasick.Automaton()
    for magic, ks in found.items():
        automaton.add_word(magic, (len(magic), ks))
    automaton.make_automaton()
    return automaton


_BLANK = re.compile("[\ufeff \t\r\n\f]*")


def _plain(data: bytes) -> str:
    """The type of what has no signature."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return "application/octet-stream"
    if "\0" in text:
        return "application/octet-stream"
    at = 0
    while True:  # behind white space, comments and an XML declaration, however long
        at = _BLANK.match(text, at).end()
        mark = next((m for m in (("<!--", "-->"), ("<?xml", "?>")) if text.startswith(m[0], at)), None)
        end = text.find(mark[1], at) if mark else -1
        if end < 0:
            return "text/html" if text[at : at + 14].lower().startswith(("<!doctype html", "<html")) else "text/plain"
        at = end + len(mark[1])


def sniff(data: bytes) -> tuple[str, int, list[tuple[str, int, int]]]:
    """The type of the whole, the length of the object at its start, and (type, offset, length) of what is embedded.

    Embedded objects are taken from left to right and don't overlap each other; they may lie inside the first
    object (a picture stored in an archive) or after it.
    """
    _headers.clear()
    _directories.clear()
    hits = []
    for end, (size, ks) in _automaton().iter(data.decode("latin-1")):
        for k in ks:
            start = end + 1 - size - FORMATS[k][2]
            if start >= 0:
                hits.append((start, k))
    view, kind, length, embedded, free = memoryview(data), None, len(data), [], 0
    for start, k in sorted(hits):
        if start and start < free or not start and kind:
            continue
        found = FORMATS[k][3](view, start)
        if found is None:
            continue
        if start == 0:
            kind, length = FORMATS[k][0], found
        else:
            embedded.append((FORMATS[k][0], start, found))
            free = start + found
    return kind or _plain(data), length, embedded


_EMBEDDED = [("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
SCHEMA = "media_id bigint, declared string, detected string, corrected boolean, size bigint, length bigint, embedded array<struct<type: string, offset: bigint, length: bigint>>"


def inspect(media: DataFrame, id: str = "media_id", content: str = "content", declared: str = "declared", carved: bool = False) -> DataFrame:
    """media_id, declared, detected, corrected, size, length, embedded of each row.

    carved: each embedded object has its content too, the bytes that carve() gives.

    corrected: the declared type was wrong, or missing, and detected replaces it.  length < size: something
    follows the object.  A null content has a null detected type and nothing embedded and isn't corrected; an
    empty one is text/plain of length 0; an empty table gives no rows.  Values are read whole, however long.  Repeated
    rows stay repeated; other columns play no part.
    """
    narrow = media.select(F.col(id).cast("bigint").alias("media_id"), F.col(declared).alias("declared"), F.col(content).alias("content"))
    embedded = pa.list_(pa.struct(_EMBEDDED + [("content", pa.binary())] * carved))

    def objects(data: bytes, found: list[tuple[str, int, int]]) -> list[dict]:
        return [{"type": kind, "offset": at, "length": n} | ({"content": data[at : at + n]} if carved else {}) for kind, at, n in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, said = batch.column("content"), batch.column("declared").to_pylist()
            found = [sniff(v.as_py()) if v.is_valid else None for v in values]
            columns = [
                batch.column("media_id"),
                batch.column("declared"),
                pa.array([f and f[0] for f in found], pa.string()),
                pa.array([f is not None and f[0] != s for f, s in zip(found, said)]),
                pa.array([len(v.as_py()) if v.is_valid else None for v in values], pa.int64()),
                pa.array([None if f is None else f[1] for f in found], pa.int64()),
                pa.array([objects(v.as_py(), f[2]) if f and f[2] else [] for v, f in zip(values, found)], embedded),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["media_id", "declared", "detected", "corrected", "size", "length", "embedded"])

    return narrow.mapInArrow(run, SCHEMA.replace("length: bigint>", "length: bigint, content: binary>") if carved else SCHEMA)


def carve(media: DataFrame, id: str = "media_id", content: str = "content", declared: str = "declared") -> DataFrame:
    """media_id, type, offset, content of every embedded object, as a row of its own.

    A null or empty content has none, an empty table gives no rows; repeated rows give their objects again; a null
    id stays null; other columns play no part.
    """
    narrow = media.select(F.col(id).cast("bigint").alias("media_id"), F.col(content).alias("content")).where("content is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, kind, at, data[at : at + n]) for i, data in zip(batch.column("media_id").to_pylist(), batch.column("content").to_pylist()) for kind, at, n in sniff(data)[2]]
            ids, kinds, offsets, parts = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(offsets, pa.int64()), pa.array(parts, pa.binary())], ["media_id", "type", "offset", "content"])

    return narrow.mapInArrow(run, "media_id bigint, type string, offset bigint, content binary")


# -- a media column for the query: the given tables have none -----------------------------------------
def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(data: bytes) -> bytes:
    """A picture of one pixel with data as a private chunk."""
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + _chunk(b"teXt", data) + _chunk(b"IDAT", zlib.compress(b"\0\0")) + _chunk(b"IEND", b"")


def jpeg(data: bytes) -> bytes:
    """A frame of one pixel with data as comments."""
    comments = b"".join(b"\xff\xfe" + struct.pack(">H", len(data[i : i + 65533]) + 2) + data[i : i + 65533] for i in range(0, len(data), 65533))
    frame, scan = b"\xff\xc0" + struct.pack(">HBHHBBBB", 11, 8, 1, 1, 1, 1, 0x11, 0), b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 0, 63, 0)
    return b"\xff\xd8" + comments + frame + scan + b"\x3f\xff\xd9"


def _riff_of(kind: bytes, *chunks: tuple[bytes, bytes]) -> bytes:
    body = kind + b"".join(name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2) for name, data in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wav(data: bytes) -> bytes:
    return _riff_of(b"WAVE", (b"fmt ", struct.pack("<HHIIHH", 1, 1, 8000, 8000, 1, 8)), (b"data", data))


def webp(data: bytes) -> bytes:
    return _riff_of(b"WEBP", (b"VP8X", struct.pack("<IIH", 4, 0, 0)), (b"XMP ", data))


def avi(data: bytes) -> bytes:
    return _riff_of(b"AVI ", (b"JUNK", data), (b"LIST", b"movi"))


def ogg(data: bytes) -> bytes:
    """One packet over as many pages as it takes."""
    table = bytes([255] * (len(data) // 255) + [len(data) % 255])
    out, flip = [], bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
    for k in range(0, len(table), 255):
        part, body = table[k : k + 255], data[k * 255 : (k + 255) * 255]
        flags = (k > 0) + 2 * (k == 0) + 4 * (k + 255 >= len(table))
        head = b"OggS" + struct.pack("<BBQII", 0, flags, 0, 1, k // 255)
        # Ogg's sum is zlib's with the bits of each byte, and of the result, the other way round and no inversion
        crc = zlib.crc32((head + b"\0" * 4 + bytes([len(part)]) + part + body).translate(flip), 0xFFFFFFFF) ^ 0xFFFFFFFF
        out.append(head + struct.pack(">I", crc).translate(flip) + bytes([len(part)]) + part + body)
    return b"".join(out)


def mp4(data: bytes) -> bytes:
    return struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 8 + len(data), b"mdat") + data


def bmp(data: bytes) -> bytes:
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(data), 0, 54, 40, len(data), 1, 1, 8, 0, 0, 0, 0, 0, 0) + data


def gif(data: bytes) -> bytes:
    blocks = b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255))
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x21\xfe" + blocks + b"\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0" + b"\x3b"


def pdf(data: bytes) -> bytes:
    body = b"%PDF-1.4\n1 0 obj\n<< /Length " + str(len(data)).encode() + b" >>\nstream\n" + data.replace(b"%", b" ") + b"\nendstream\nendobj\n"
    return body + b"xref\n0 1\n0000000000 65535 f \ntrailer\n<< /Size 2 >>\nstartxref\n" + str(len(body)).encode() + b"\n%%EOF"


def stored_zip(name: bytes, data: bytes) -> bytes:
    crc = zlib.crc32(data)
    local = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 20, 0, 0, 0, 33, crc, len(data), len(data), len(name), 0) + name + data
    entry = b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 20, 20, 0, 0, 0, 33, crc, len(data), len(data), len(name), 0, 0, 0, 0, 0, 0) + name
    return local + entry + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(entry), len(local), 0)


def gz(data: bytes) -> bytes:
    coder = zlib.compressobj(1, zlib.DEFLATED, 31)
    return coder.compress(data) + coder.flush()


def xz(data: bytes) -> bytes:
    return lzma.compress(data, preset=0)


#: (declared type, how a text is packed): some declarations are wrong, some values hold others.
PACKINGS: list[tuple[str, Callable[[bytes], bytes]]] = [
    ("text/plain", lambda t: t),
    ("image/png", png),
    ("image/jpeg", png),
    ("audio/wav", wav),
    ("image/bmp", bmp),
    ("image/gif", gif),
    ("application/pdf", pdf),
    ("application/zip", lambda t: stored_zip(b"a.png", png(t))),
    ("text/plain", gz),
    ("application/octet-stream", lambda t: t + png(t[:64]) + t[:9] + wav(t[:100])),
    ("application/pdf", lambda t: stored_zip(b"a.wav", wav(t)) + gif(t[:300])),
    ("image/jpeg", jpeg),
    ("image/png", webp),
    ("video/avi", avi),
    ("application/x-bzip2", bz2.compress),
    ("application/gzip", xz),
    ("audio/ogg", ogg),
    ("video/mp4", mp4),
    ("application/zip", lambda t: stored_zip(b"a.mp4", mp4(t)) + jpeg(t[:200])),
    ("application/octet-stream", lambda t: t + webp(t[:64]) + avi(t[:64]) + t[:9] + bz2.compress(t[:64]) + xz(t[:64]) + ogg(t[:300])),
]


def packed(docs: DataFrame) -> DataFrame:
    """media_id, declared, content: each document's whole text in a container that its doc_id chooses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, said, out = part.column("media_id").to_pylist(), [], []
                for i, text in zip(ids, part.column("text").to_pylist()):
                    declared, pack = PACKINGS[(i or 0) * 2654435761 % 4294967296 % len(PACKINGS)]
                    said.append(declared)
                    out.append(None if text is None else pack(text.encode("utf-8")))
                yield pa.RecordBatch.from_arrays([part.column("media_id"), pa.array(said, pa.string()), pa.array(out, pa.binary())], ["media_id", "declared", "content"])

    return docs.select(F.col("doc_id").cast("bigint").alias("media_id"), "text").mapInArrow(run, "media_id bigint, declared string, content binary")
