import hashlib
import urllib.parse
import uuid

import zstandard

from glyphmeter.llm import warc

SCHEMA = "page_id bigint, url string, html string, bundle string, frame string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


ROWS = [(i, f"http://a.example/{i}", f"<p>{'text ' * (i % 50)}{i}</p>") for i in range(500)]
ODD = [(7, "http://a.example/7", "<p>again</p>"), (7, "http://a.example/7", "<p>again</p>"), (None, "http://x", "null id"), (901, None, "no url"), (902, "http://x", None), (903, "http://x y\n", ""), (904, "http://long", "é" * 400000)]


def test_round_trip(spark):
    bundled = warc.bundles(pages(spark, ROWS + ODD), frame_bytes=4096, bundle_bytes=60000)
    assert bundled.count() > 1
    got = sorted((r["record_id"] if r["record_id"] is not None else -1, bytes(r["record"])) for r in warc.extract(bundled).collect())
    want = sorted((i if i is not None else -1, warc.record(i, u, h)[1]) for i, u, h in ROWS + ODD)
    assert got == want


def parsed(data):
    """Header fields and body of each record, by a reader that knows the format only."""
    at, out = 0, []
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8").split("\r\n")
        assert first == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        body = data[end + 4 : end + 4 + size]
        assert data[end + 4 + size :][:4] == b"\r\n\r\n"
        at = end + 8 + size
        out.append((fields, body))
    return out


def test_records_by_another_reader(spark):
    rows = ROWS[:60] + ODD
    bundled = warc.bundles(pages(spark, rows).coalesce(1), frame_bytes=4096).collect()
    found = [r for b in bundled for r in parsed(zstandard.ZstdDecompressor().stream_reader(bytes(b["bundle"]), read_across_frames=True).read())]
    index = [e for b in bundled for e in b["index"]]
    assert [e["record_id"] for e in index] == [r[0] for r in rows] and len(found) == len(rows)
    for (fields, body), e, (_, url, html) in zip(found, index, rows):
        assert body == (html or "").encode() and fields["WARC-Type"] == "resource"
        assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(body).hexdigest()
        assert fields["WARC-Record-ID"] == f"<urn:uuid:{e['warc_id']}>" and uuid.UUID(e["warc_id"]).version == 5
        assert urllib.parse.unquote(fields.get("WARC-Target-URI", "")) == (url or "").strip() and " " not in fields.get("WARC-Target-URI", "")
    for b in bundled:  # and the index by plain slicing of the raw frames
        data, frames, at = bytes(b["bundle"]), [], 0
        while at < len(data) and data[at : at + 4] == b"\x28\xb5\x2f\xfd":
            coder = zstandard.ZstdDecompressor().decompressobj()
            frames.append(coder.decompress(data[at:]))
            at = len(data) - len(coder.unused_data)
        assert [parsed(frames[e["frame"]][e["offset"] : e["offset"] + e["length"]])[0][0]["WARC-Record-ID"] for e in b["index"]] == [f"<urn:uuid:{e['warc_id']}>" for e in b["index"]]


def test_dates_come_from_a_column(spark):
    rows = spark.createDataFrame([(1, "http://a", "x", "2024-05-06 07:08:09"), (2, "http://a", "x", None)], "page_id bigint, url string, html string, at string")
    got = {r["record_id"]: bytes(r["record"]) for r in warc.extract(warc.bundles(rows, date="at")).collect()}
    assert b"WARC-Date: 2024-05-06T07:08:09Z\r\n" in got[1] and b"WARC-Date: 1970-01-01T00:00:00Z\r\n" in got[2]


def test_frames_stand_alone(spark):
    row = warc.bundles(pages(spark, ROWS).coalesce(1), frame_bytes=4096).first()
    data, table = bytes(row["bundle"]), warc.read_seek_table(bytes(row["bundle"]))
    assert len(table) == row["frames"] > 3
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()  # plain readers skip the table
    parts = [zstandard.ZstdDecompressor().decompress(data[a : a + n], max_output_size=raw) for a, n, raw in table]
    assert whole == b"".join(parts) and [len(p) for p in parts] == [raw for *_, raw in table]
    for e in row["index"][::37]:
        page = ROWS[e["record_id"]]
        assert warc.read_record(data, e["frame"], e["offset"], e["length"]) == warc.record(*page)[1]


def test_equal_input_gives_equal_bundles(spark):
    a, b = (sorted(r["bundle_id"] for r in warc.bundles(pages(spark, ROWS).coalesce(1)).collect()) for _ in range(2))
    assert a == b


def test_locate_and_edges(spark):
    bundled = warc.bundles(pages(spark, ROWS + ODD))
    assert warc.locate(bundled).count() == len(ROWS) + len(ODD)
    assert warc.bundles(pages(spark, [])).count() == 0
    header = warc.record(1, "http://x y\n", "é")[1].split(b"\r\n\r\n")[0]
    assert header.startswith(b"WARC/1.1\r\n") and b"Content-Length: 2" in header and b"WARC-Target-URI: http://x%20y" in header
