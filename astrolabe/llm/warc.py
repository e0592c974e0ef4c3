"""WARC archives as seekable Zstandard bundles.

A bundle is one file of independent Zstandard frames, each holding some whole
WARC records, followed by a seek table in a skippable frame (the seekable
format's footer), so any record can be read by decompressing one frame.  The
manifest maps each record to its bundle, frame and place inside the frame.

Of records with equal payloads of ``REVISIT_BYTES`` or more, the one with the
largest identifier is the response and the others are revisits of it.  Equal
payloads are found by SHA-1 and length on narrow rows; only then do the payloads
move, once, to their bundle.

Each task writes its bundles under names of its own attempt, in the folder given
(by default one below ``spark.checkpoint.dir``); the manifest is a written table,
which names the files of the attempts that counted.  A lost executor's task is
run again and its manifest rows name the new files.

Defined results: a null payload is an empty one; a record without identifier or
address is written with an empty one; equal rows with the response's identifier
are all responses; long payloads get a frame of their own; an empty table gives
no bundle; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolabe.llm import register
from astrolabe.llm.common import materialise, table, text_batches
from astrolabe.session import scratch_path

REVISIT_BYTES = 1000
FRAME_BYTES = 1 << 20       # records are added to a frame until it holds as much
#: Packed bytes of frames that a task reads back, on average.
READ_BYTES = 4 << 20
BUNDLE_BYTES = 256 << 20    # and frames to a bundle
LEVEL = 3
# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
#: Every record carries this date, so that archives of equal tables are equal.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = ("page_id string, record_type string, bundle string, record int, frame int, frame_offset long, "
            "frame_bytes int, start int, bytes int")


def record_id(page_id: str | None) -> str:
    return f"<urn:page:{page_id or ''}>"


def line_safe(url: str) -> str:
    """The address as it is, but for line ends, which would end the header line, and a leading blank, which belongs to it."""
    safe = url.replace("\r", "%0D").replace("\n", "%0A")
    return "%20" + safe[1:] if safe.startswith(" ") else safe


def build_record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header only, whose length names the full payload's."""
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
             ).encode() + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {line_safe(url or '')}", f"WARC-Payload-Digest: {digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one record, and its payload (None for a revisit)."""
    head, rest = data.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, payload = block.split(b"\r\n\r\n", 1)
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and len(payload) != length:
        raise ValueError("a payload does not have the length of its header")
    return fields | {"payload": None if revisit else payload, "payload_bytes": length}


class BundleWriter:
    """Writes one seekable bundle; ``add`` gathers records, ``close`` writes the seek table."""

    def __init__(self, files: pafs.FileSystem, path: str) -> None:
        self.files, self.path, self.out = files, path, files.open_output_stream(path, compression=None)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.offset, self.buffer, self.waiting, self.rows = 0, bytearray(), [], 0

    def add(self, page_id: str | None, kind: str, data: bytes) -> list[tuple]:
        self.waiting.append((page_id, kind, self.rows, len(self.buffer), len(data)))
        self.rows += 1
        self.buffer += data
        return self.flush() if len(self.buffer) >= FRAME_BYTES else []

    def flush(self) -> list[tuple]:
        """Closes the frame; manifest rows of its records."""
        if not self.waiting:
            return []
        packed = self.packer.compress(bytes(self.buffer))
        self.out.write(packed)
        rows = [(page, kind, self.path, k, len(self.frames), self.offset, len(packed), start, size)
                for page, kind, k, start, size in self.waiting]
        self.frames.append((len(packed), len(self.buffer)))
        self.offset += len(packed)
        self.buffer, self.waiting = bytearray(), []
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        entries = b"".join(struct.pack("<II", a, b) for a, b in self.frames)
        body = entries + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.out.close()
        return rows


def seek_table(source) -> list[tuple[int, int, int]]:
    """``(offset, packed bytes, bytes)`` of each frame, read from the end of an open bundle."""
    size = source.size()
    source.seek(size - 9)
    frames, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("the file ends without a seek table")
    entry = 12 if flags & 0x80 else 8
    source.seek(size - 9 - frames * entry)
    table_bytes = source.read(frames * entry)
    out, offset = [], 0
    for k in range(frames):
        packed, full = struct.unpack_from("<II", table_bytes, k * entry)
        out.append((offset, packed, full))
        offset += packed
    return out


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``id, url, payload, digest, response_id`` per row; ``response_id`` is null for a response."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    narrow = pages.select(F.col(id_col).alias("id"), F.sha1(payload).alias("g_digest"), F.sha2(payload, 256).alias("g_check"),
                          F.octet_length(payload).alias("g_size"))
    groups = (narrow.where(F.col("g_size") >= REVISIT_BYTES).groupBy("g_digest", "g_check", "g_size")
              .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
              .where("copies > 1 AND keep_id IS NOT NULL").drop("copies"))
    full = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
                        F.sha1(payload).alias("digest"))
    same = (F.col("digest") == F.col("g_digest")) & (F.sha2("payload", 256) == F.col("g_check")) & (F.octet_length("payload") == F.col("g_size"))
    revisit = F.col("keep_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep_id"))
    return (full.join(groups, same, "left")
            .select("id", "url", "payload", "digest", F.when(revisit, F.col("keep_id")).alias("response_id")))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html") -> DataFrame:
    """Writes the records of ``pages`` as bundles below ``folder``; the manifest, as a written table."""
    text_batches(pages.sparkSession)
    ready = (classify(pages, id_col, url_col, payload_col)
             .select(F.col("id").cast("string").alias("page_id"), "url", "payload", "digest",
                     F.col("response_id").cast("string").alias("refers_to")))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        writer = None
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, refers_to in zip(*(batch[c] for c in batch.columns)):
                writer = writer or BundleWriter(files, f"{base}/{uuid.uuid4().hex}.warc.zst")
                page_id, url, refers_to = (x if isinstance(x, str) else None for x in (page_id, url, refers_to))
                data = build_record(page_id, url, bytes(payload), digest, refers_to)
                rows += writer.add(page_id, "response" if refers_to is None else "revisit", data)
                if writer.offset >= BUNDLE_BYTES:
                    rows += writer.close()
                    writer = None
            if rows:
                yield _manifest(rows)
        if writer:
            yield _manifest(writer.close())

    return materialise(ready.mapInPandas(kernel, MANIFEST), "warc-manifest")


def _manifest(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in MANIFEST.split(", ")])


def read_records(wanted: DataFrame, folder: str) -> DataFrame:
    """The archived records of manifest rows ``wanted``: each frame named there is fetched once by its offset.

    Any part of a manifest will do: it is grouped by frame, and a frame's place
    is held against the bundle's own seek table.
    """
    out = ("page_id string, record_type string, url string, payload binary, payload_bytes long, payload_digest string, "
           "refers_to string")
    frames = (wanted.groupBy("bundle", "frame", "frame_offset", "frame_bytes")
              .agg(F.sort_array(F.collect_list(F.struct("start", "bytes"))).alias("places")))
    # the manifest is a few bytes a record; what a task fetches are the frames
    size = wanted.select("bundle", "frame", "frame_bytes").distinct().agg(F.sum("frame_bytes")).first()[0] or 0
    frames = frames.repartition(max(1, -(-size // READ_BYTES)), "bundle", "frame")

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, _ = pafs.FileSystem.from_uri(folder)
        tables: dict[str, list] = {}
        for batch in batches:
            for bundle, frame, offset, size, places in zip(*(batch[c] for c in batch.columns)):
                with files.open_input_file(bundle) as source:
                    if bundle not in tables:
                        tables = {bundle: seek_table(source)}  # one at a time: frames come bundle by bundle
                    at = tables[bundle][frame]
                    if at[:2] != (offset, size):
                        raise ValueError(f"{bundle}: the seek table and the manifest differ for frame {frame}")
                    source.seek(offset)
                    data = zstandard.ZstdDecompressor().decompress(source.read(size), max_output_size=at[2])
                rows = []
                for place in places:
                    r = parse_record(data[place["start"]:place["start"] + place["bytes"]])
                    if r["payload"] is not None and hashlib.sha1(r["payload"]).hexdigest() != r["WARC-Payload-Digest"]:
                        raise ValueError(f"{bundle}: a payload does not have its digest")
                    rows.append((_page(r["WARC-Record-ID"]), r["WARC-Type"], r["WARC-Target-URI"], r["payload"], r["payload_bytes"],
                                 r["WARC-Payload-Digest"], _page(r.get("WARC-Refers-To"))))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")])

    return frames.sortWithinPartitions("bundle", "frame").mapInPandas(kernel, out)


def _page(urn: str | None) -> str | None:
    return (urn[len("<urn:page:"):-1] or None) if urn else None


@register("op10_warc_archive", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, strlen(html) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS keep FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN keep END AS refers_to
FROM g
""")
def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, as read back from the archives just written."""
    folder = scratch_path(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    back = read_records(manifest, folder)
    return back.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast("long").alias("refers_to"))
