import io
import random
import zipfile
import zlib

import pytest

from glyphmeter.llm import media

TEXT = "Some text, é, which is held. ".encode() * 20
MADE = {"image/png": media.png, "audio/wav": media.wav, "image/bmp": media.bmp, "image/gif": media.gif, "application/pdf": media.pdf, "application/gzip": media.gz, "application/zip": lambda t: media.stored_zip(b"n.txt", t)}


@pytest.mark.parametrize("kind", MADE)
def test_each_format(kind):
    data = MADE[kind](TEXT)
    assert media.sniff(data) == (kind, len(data), [])
    assert media.sniff(data + b"tail")[:2] == (kind, len(data))
    assert media.sniff(data[:-1])[0] != kind  # cut short: the structure doesn't hold
    assert media.sniff(b"lead" + data + b"tail")[2] == [(kind, 4, len(data))]


def test_real_archives_and_streams():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", TEXT)
        z.writestr("b", "x")
    assert media.sniff(buffer.getvalue())[:2] == ("application/zip", len(buffer.getvalue()))
    import bz2
    import lzma

    for kind, data in (("application/x-bzip2", bz2.compress(TEXT)), ("application/x-xz", lzma.compress(TEXT))):
        assert media.sniff(data + b"more")[:2] == (kind, len(data))


def test_jpeg_mp4_ogg_webp():
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xc0\x00\x08\x08\x00\x01\x00\x01\x00" + b"\xff\xda\x00\x02" + b"\x01\xff\x00\x02\xff\xd0\x03" + b"\xff\xd9"
    assert media.sniff(jpeg + b"zz")[:2] == ("image/jpeg", len(jpeg))
    mp4 = b"\0\0\0\x10ftypisom\0\0\0\0" + b"\0\0\0\x0cmdatabcd"
    assert media.sniff(mp4 + b"\0\0\0\0rest")[:2] == ("video/mp4", len(mp4))
    ogg = b"OggS\0\x04" + b"\0" * 20 + b"\x01\x03abc"
    assert media.sniff(ogg)[:2] == ("audio/ogg", len(ogg))
    webp = b"RIFF\x0e\0\0\0WEBPVP8 \x02\0\0\0ab"
    assert media.sniff(webp)[:2] == ("image/webp", len(webp))


def test_magic_without_structure_is_no_media():
    for _, magic, _, _ in media.FORMATS:
        assert media.sniff(b"words " + magic + b" words")[2] == []
    assert media.sniff(b"GIF89a is a format")[0] == "text/plain"
    assert media.sniff(b"<!DOCTYPE html><p>")[0] == "text/html"
    assert media.sniff(b"\xff\xfe\x00")[0] == "application/octet-stream"
    broken = bytearray(media.png(TEXT))
    broken[60] ^= 1
    assert media.sniff(bytes(broken))[0] != "image/png"


def test_html_behind_a_long_head():
    for head in (" " * 6000, f"<!-- {'x' * 6000} -->", "\ufeff<?xml version='1.0'?>\n" + "<!-- a -->\n" * 500):
        assert media.sniff((head + "<HTML><p>").encode())[0] == "text/html"
        assert media.sniff((head + "words <html>").encode())[0] == "text/plain"
    assert media.sniff(b"<!-- never closed <html>")[0] == "text/plain"


def test_bombs_take_no_memory():
    import bz2
    import lzma
    import resource

    zeros = bytes(1 << 28)
    bombs = {"application/x-bzip2": bz2.compress(zeros), "application/gzip": media.gz(zeros), "application/x-xz": lzma.compress(zeros)}
    del zeros
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for kind, data in bombs.items():
        assert media.sniff(data + b"more")[:2] == (kind, len(data))
        assert media.sniff(data[:-9])[0] != kind
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # KB


def test_many_headers_take_linear_time():
    import time

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for k in range(20000):
            z.writestr(str(k), "x" * 20)
    began = time.perf_counter()
    assert media.sniff(buffer.getvalue())[:2] == ("application/zip", len(buffer.getvalue()))
    assert media.sniff(b"%PDF-1 startxref " * 40000)[0] == "text/plain"
    streamed = b"".join(b"PK\x03\x04" + b"\x14\0\x08\0" + b"\0" * 22 + b"data" for _ in range(40000))
    assert media.sniff(streamed + b"PK\x01\x02")[0] == "application/octet-stream"
    assert time.perf_counter() - began < 20


def brute(data):
    """Every format tried at every offset."""
    view, kind, length, found, free = memoryview(data), None, len(data), [], 0
    for at in range(len(data)):
        for name, magic, skip, check in media.FORMATS:
            if data[at + skip : at + skip + len(magic)] == magic and (at == 0 and kind is None or at > 0 and at >= free) and (n := check(view, at)) is not None:
                if at == 0:
                    kind, length = name, n
                else:
                    found.append((name, at, n))
                    free = at + n
    return kind or media._plain(data), length, found


@pytest.mark.parametrize("seed", range(8))
def test_against_brute_force(seed):
    rng = random.Random(seed)
    data = b"".join(rng.choice([bytes(rng.randrange(256) for _ in range(rng.randrange(30))), MADE[rng.choice(list(MADE))](TEXT[: rng.randrange(200)]), b"PK\x03\x04", b"RIFF"]) for _ in range(8))
    assert media.sniff(data) == brute(data)


SCHEMA = "media_id bigint, content binary, declared string, detected string, size string"


def test_table(spark):
    png = media.png(TEXT)
    rows = [(1, png, "image/png"), (1, png, "image/png"), (2, png, "image/jpeg"), (3, None, "image/png"), (4, b"", None), (None, b"text" + png, "text/plain"), (5, TEXT * 5000, "text/plain")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = sorted(((r["media_id"], r["detected"], r["corrected"], r["length"], len(r["embedded"])) for r in media.inspect(df).collect()), key=repr)
    want = [(1, "image/png", False, len(png), 0)] * 2 + [(2, "image/png", True, len(png), 0), (3, None, False, None, 0), (4, "text/plain", True, 0, 0), (None, "application/octet-stream", True, 4 + len(png), 1), (5, "text/plain", False, len(TEXT) * 5000, 0)]
    assert got == sorted(want, key=repr)
    assert [bytes(r["content"]) for r in media.carve(df).collect()] == [png]
    none = spark.createDataFrame([], SCHEMA)
    assert media.inspect(none).count() == media.carve(none).count() == 0


def test_packed_documents(spark):
    docs = spark.createDataFrame([(i, "some words " * i) for i in range(40)] + [(None, None)], "doc_id bigint, text string")
    got = media.inspect(media.packed(docs)).collect()
    assert len(got) == 41 and {r["detected"] for r in got if r["detected"]} >= {"image/png", "audio/wav", "application/zip", "text/plain"}
    assert zlib.crc32(b"") == 0


def test_packings_make_every_format():
    text = TEXT * 200
    for t in (b"x", text):
        found = [media.sniff(pack(t)) for _, pack in media.PACKINGS]
        formats = {f[0] for f in media.FORMATS}
        assert {kind for kind, _, _ in found} >= formats and {e[0] for _, _, inside in found for e in inside} >= formats - {"application/zip", "application/pdf", "application/gzip", "image/bmp"}
    for make in (media.jpeg, media.webp, media.avi, media.xz, media.ogg, media.mp4):
        assert media.sniff(make(text))[1:] == (len(make(text)), [])


def test_query_carves(spark, tmp_path):
    from glyphmeter.llm import queries

    docs = spark.createDataFrame([(i, f"words {i} " * i) for i in range(60)], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["media_id"], e["type"], e["offset"], bytes(e["content"])) for r in queries.op4_media(spark, str(tmp_path)).collect() for e in r["embedded"])
    want = sorted((r["media_id"], r["type"], r["offset"], bytes(r["content"])) for r in media.carve(media.packed(docs)).collect())
    assert got == want and {kind for _, kind, _, _ in got} >= {"image/png", "image/jpeg", "video/mp4", "audio/ogg"}
