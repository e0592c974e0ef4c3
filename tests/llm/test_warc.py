"""WARC bundles: exact round trip, random access, format, revisits, odd rows."""

import hashlib
import io
import struct

import pyarrow.fs as pafs
import zstandard

from astrolabe.llm import warc
from astrolabe.llm.warc import build_record, parse_record, read_records, seek_table, write_archives
from tests.conftest import SF_SMALL


def test_record_round_trip():
    for payload in (b"", b"<html>\r\n\r\nx</html>\r\n\r\n", "é漢😀".encode() * 999):
        digest = hashlib.sha1(payload).hexdigest()
        r = parse_record(build_record("7", "http://a/?b=c d\r\nX: y", payload, digest, None))
        assert (r["payload"], r["payload_bytes"], r["WARC-Payload-Digest"]) == (payload, len(payload), digest)
        assert r["WARC-Record-ID"] == "<urn:page:7>" and r["WARC-Target-URI"] == "http://a/?b=c d%0D%0AX: y"
        v = parse_record(build_record("7", None, payload, digest, "9"))
        assert v["payload"] is None and v["payload_bytes"] == len(payload) and v["WARC-Refers-To"] == "<urn:page:9>"


def test_bundles_hold_every_page(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 20_000)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 60_000)
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    folder = f"file://{tmp_path}/w"
    manifest = write_archives(pages, folder)
    rows = {r.page_id: r for r in manifest.collect()}
    html = {str(r.page_id): (r.html or "").encode() for r in pages.collect()}
    assert set(rows) == set(html)
    files = pafs.LocalFileSystem()
    for r in rows.values():  # random access by frame-relative place
        with files.open_input_file(r.bundle) as f:
            offset, packed, full = seek_table(f)[r.frame]
            assert (offset, packed) == (r.frame_offset, r.frame_bytes)
            f.seek(offset)
            data = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=full)
        record = parse_record(data[r.start:r.start + r.bytes])
        assert record["WARC-Record-ID"] == f"<urn:page:{r.page_id}>"
    whole = b""  # a plain reader that skips the seek table sees all records in a row
    for bundle in {r.bundle for r in rows.values()}:
        raw = open(bundle, "rb").read()
        assert struct.unpack("<I", raw[-4:])[0] == warc.SEEKABLE_MAGIC
        whole += zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(html)
    back = {r.page_id: r for r in read_records(manifest, folder).collect()}
    for k, payload in html.items():
        response = back[back[k].refers_to] if back[k].refers_to else back[k]
        assert bytes(response.payload) == payload and back[k].payload_bytes == len(payload)
    some = manifest.where("page_id IN ('3', '7')")
    assert sorted(r.page_id for r in read_records(some, folder).collect()) == ["3", "7"]


def test_odd_rows(spark, tmp_path):
    big, small = "x" * 1000, "x" * 999
    rows = [(1, "u", big, "a"), (5, None, big, "b"), (5, "u", big, "c"), (None, "u", big, None), (2, "u", small, ""), (3, "u", small, ""),
            (4, "u", None, ""), (6, "u", "é" * 500, ""), (7, "u", "é" * 500, ""), (8, "u", "y" * 3_000_000, ""), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    folder = f"file://{tmp_path}/w"
    back = read_records(write_archives(pages, folder), folder).collect()
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in back)
    assert got == sorted([("1", 1000, "revisit", "5"), ("5", 1000, "response", "None"), ("5", 1000, "response", "None"),
                          ("None", 1000, "revisit", "5"), ("2", 999, "response", "None"), ("3", 999, "response", "None"),
                          ("4", 0, "response", "None"), ("6", 1000, "revisit", "7"), ("7", 1000, "response", "None"),
                          ("8", 3_000_000, "response", "None"), ("None", 0, "response", "None")])
    empty = write_archives(pages.limit(0), folder)
    assert empty.count() == 0 and read_records(empty, folder).count() == 0


def test_addresses_are_kept(spark, tmp_path):
    urls = {1: "http://x/a  b", 2: "http://x/a\r\nWARC-Type: other", 3: " http://x/ ", 4: "http://x/\u00e9: \t~", 5: ""}
    pages = spark.createDataFrame([(k, u, "p") for k, u in urls.items()], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    back = {r.page_id: r.url for r in read_records(write_archives(pages, folder), folder).collect()}
    assert back == {"1": urls[1], "2": "http://x/a%0D%0AWARC-Type: other", "3": "%20http://x/ ", "4": urls[4], "5": ""}


def test_reading_tasks_follow_the_archive(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 2000)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    folder = f"file://{tmp_path}/w"
    manifest = write_archives(pages, folder)
    size = sum(r.frame_bytes for r in manifest.select("bundle", "frame", "frame_bytes").distinct().collect())
    assert read_records(manifest, folder).rdd.getNumPartitions() == -(-size // 2000) > 3
