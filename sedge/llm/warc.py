"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent zstd frames, each with whole WARC records, closed by a skippable frame that holds a
seek table (compressed and decompressed size of every frame; the public "seekable format" layout). The index maps each record to
(bundle, frame, offset within the decompressed frame, length). Bundles are written to the shared folder under names
of their own for every attempt, and the index names only those of attempts that succeeded, so a retried task leaves
at most an unreferenced file behind.
"""

from __future__ import annotations

import hashlib
import math
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, functions as F

from sedge.runtime import cut, scratch_path

# Fixed values of the zstd seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CRLF = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
LEAST_SHARED = 100
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
#: Bytes of records that one task reads back.
READ_BYTES = 16 << 20
INDEX = "page_id long, record_type string, bundle string, frame int, offset long, length long"
FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame for (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def record(kind: str, record_id: str, block: bytes, *, url: str | None = None, digest: str = "", payload_bytes: int = 0, refers_to: str = "", date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record. Line ends in a URL are percent-encoded; a null URL is left out."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if digest:
        head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {payload_bytes}"]
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head.append("Content-Type: " + ("application/warc-fields" if kind == "warcinfo" else "application/http; msgtype=response"))
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF


@dataclass
class Record:
    kind: str
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(CRLF + CRLF)[2]


def parse(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record at ``at`` and where the next one starts."""
    end = data.index(CRLF + CRLF, at)
    lines = data[at:end].decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    start, n = end + 4, int(headers["Content-Length"])
    if lines[0] != "WARC/1.1" or data[start + n : start + n + 4] != CRLF + CRLF:
        raise ValueError(f"no whole record at {at}")
    return Record(headers["WARC-Type"], headers, data[start : start + n]), start + n + 4


class Bundle:
    """Random access to the frames of a bundle through its seek table."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        table = struct.unpack(f"<{2 * n}I", self.file.read_at(8 * n, size - 9 - 8 * n))
        self.sizes, self.starts, at = table[1::2], [], 0
        for compressed in table[::2]:
            self.starts.append((at, compressed))
            at += compressed

    def frame(self, k: int) -> bytes:
        at, n = self.starts[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(n, at), max_output_size=self.sizes[k])

    def record(self, frame: int, offset: int) -> Record:
        return parse(self.frame(frame), offset)[0]


class _Writer:
    def __init__(self, folder: str, frame_bytes: int, level: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.uri, self.frame_bytes, self.zstd = folder, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.out = None

    def _open(self) -> None:
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out, self.frames, self.size, self.pending, self.rows = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None), [], 0, bytearray(), []
        self.pending += record("warcinfo", f"urn:uuid:{uuid.UUID(self.name[:32])}", b"format: WARC file version 1.1\r\n")

    def add(self, page_id, kind: str, data: bytes) -> None:
        if self.out is None:
            self._open()
        self.rows.append((page_id, kind, f"{self.uri}/{self.name}", len(self.frames), len(self.pending), len(data)))
        self.pending += data
        if len(self.pending) >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        data = self.zstd.compress(bytes(self.pending))
        self.out.write(data)
        self.frames.append((len(data), len(self.pending)))
        self.size += len(data)
        self.pending = bytearray()

    def close(self) -> list[tuple]:
        if self.out is None:
            return []
        if self.pending:
            self._flush()
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.out = None
        return self.rows


def _urn(page_id: int | None, digest: str) -> str:
    """A record's id: its page's and its payload's; records without a page id, which nothing refers to, get one of their own."""
    return f"urn:page:{page_id}:{digest}" if page_id is not None else f"urn:page::{uuid.uuid4().hex}"


def _page(urn: str) -> int | None:
    number = urn.strip("<>").split(":")[2]
    return int(number) if number else None


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _write(folder: str, frame_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = [x.split()[0] for x in INDEX.split(", ")], [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        writer = _Writer(folder, frame_bytes, level)
        for batch in batches:
            for page_id, url, html, digest, n, first in zip(*(batch.column(k).to_pylist() for k in range(6))):
                shared = first is not None
                block = HTTP_HEAD % n + (b"" if shared else (html or "").encode())
                writer.add(page_id, "revisit" if shared else "response", record("revisit" if shared else "response", _urn(page_id, digest), block, url=url, digest=digest, payload_bytes=n, refers_to=_urn(first, digest) if shared else ""))
            if writer.out is not None and writer.size >= BUNDLE_BYTES:
                yield _table(writer.close(), names, types)
        yield _table(writer.close(), names, types)

    return run


def write_archives(pages: DataFrame, folder: str | None = None, frame_bytes: int = FRAME_BYTES, level: int = 3) -> DataFrame:
    """Write a record per row of pages(page_id, url, html) into bundles below ``folder``; return their index.

    Of rows with equal payloads of at least 100 bytes, the one with the least page_id is a response and the others
    are revisits of it; shorter payloads are all responses. Null html: an empty payload. Null page_id: a record of its own
    that revisits an equal page but is never revisited. Rows that repeat the least page_id are responses too.
    A record's id is made of its page's and its payload's digest, so only rows that repeat both share one. Other columns are ignored.
    Empty table: an empty index. Groups of equal payloads are found by a map-side combined minimum over
    (page_id, digest) rows; html moves only if the revisits are too many to broadcast.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n"))
    ids = rows.where(F.col("n") >= LEAST_SHARED).select("page_id", "digest")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).where("rows > 1 AND first IS NOT NULL").drop("rows")
    again = cut(ids.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct(), "revisits").select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "first")
    marked = rows.join(again, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")), "left").select("page_id", "url", "html", "digest", "n", "first")
    return cut(marked.mapInArrow(_write(folder, frame_bytes, level), INDEX), "warc-index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = [x.split()[0] for x in FIELDS.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    uri, bundle = None, None
    for batch in batches:
        for name, frame, offsets in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if name != uri:
                uri, bundle = name, Bundle(name)
            data, rows = bundle.frame(frame), []
            for at in offsets:
                r, _ = parse(data, at)
                digest, n, refers = r.headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(r.headers["WARC-Payload-Length"]), None
                if r.kind == "response":
                    own = r.payload
                    if hashlib.sha256(own).hexdigest() != digest or len(own) != n:
                        raise ValueError(f"payload of {r.headers['WARC-Record-ID']} differs from its digest")
                else:
                    refers = _page(r.headers["WARC-Refers-To"])
                rows.append((_page(r.headers["WARC-Record-ID"]), n, digest, r.kind, refers))
            yield _table(rows, names, types)


def read_archives(index: DataFrame) -> DataFrame:
    """All records that an index names, by their offsets: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Frames, which hold about FRAME_BYTES of records each, are dealt out by key to as many tasks as their bytes ask for;
    response payloads are hashed again and compared.
    """
    frames = index.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    size = index.agg(F.sum("length")).first()[0] or 0
    return frames.repartition(math.ceil(size / READ_BYTES) or 1, "bundle", "frame").sortWithinPartitions("bundle", "frame").mapInArrow(_read, FIELDS)
