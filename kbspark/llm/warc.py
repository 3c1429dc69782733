"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that can be decompressed for themselves. Behind the frames
stand two skippable frames: an index that maps record identifiers to (frame, offset within
the frame, length), and the seek table of the seekable format, which gives every frame's
compressed and decompressed size. Reading one record takes the footer, the index and one
frame. Every task writes bundles of its own under names that no other attempt uses; the
manifest, a table in the shared folder, names those of the attempts that counted.

Which records are revisits is found from digests alone: the smallest id of each repeated
payload by aggregation, then the ids of the other copies; only those ids are joined with the
pages. Bundles are written and read through pyarrow's file systems (file, hdfs, s3, gs).

Cases: null payload counts as empty; payloads under `least` bytes are never revisits; rows that
repeat the smallest id of a payload are all responses; rows that repeat have records of their own, numbered within a bundle; rows without an id are archived as
responses, or revisits if the payload has a smaller id; null urls have no target URI; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import column, new_path, slices, stored

FRAME, BUNDLE = 256 << 10, 32 << 20
#: Fixed values of the formats.
SKIPPABLE_SEEK, SKIPPABLE_INDEX, SEEK_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


class BundleWriter:
    """Appends records to one bundle, held in memory until it is closed; a bundle's size is bounded by its owner."""

    def __init__(self, level: int = 3):
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frame, self.frames, self.out, self.index, self.raw = [], [], [], [], 0
        self.size = 0

    def add(self, identifier: bytes, record: bytes) -> None:
        if self.raw and self.raw + len(record) > FRAME:
            self._close_frame()
        self.index.append(struct.pack("<IIIH", len(self.frames), self.raw, len(record), len(identifier)) + identifier)
        self.frame.append(record)
        self.raw += len(record)

    def _close_frame(self) -> None:
        packed = self.compressor.compress(b"".join(self.frame))
        self.out.append(packed)
        self.frames.append((len(packed), self.raw))
        self.size += len(packed)
        self.frame, self.raw = [], 0

    def to_bytes(self) -> bytes:
        if self.frame:
            self._close_frame()
        index = self.compressor.compress(b"".join(self.index))
        table = b"".join(struct.pack("<II", *x) for x in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        skip = lambda magic, body: struct.pack("<II", magic, len(body)) + body
        return b"".join([*self.out, skip(SKIPPABLE_INDEX, index), skip(SKIPPABLE_SEEK, table + footer)])


class BundleReader:
    """Random access to a bundle through read(offset, length)."""

    def __init__(self, read, size: int):
        self.read = read
        frames, _, magic = struct.unpack("<IBI", read(size - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seekable bundle")
        table = read(size - 9 - 8 * frames, 8 * frames)
        self.frames, at = [], 0
        for packed, raw in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, raw))
            at += packed
        magic, length = struct.unpack("<II", read(at, 8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("no record index")
        self.decompressor = zstandard.ZstdDecompressor()
        raw, i = self.decompressor.decompress(read(at + 8, length), max_output_size=1 << 31) if length else b"", 0
        self.index: dict[bytes, tuple[int, int, int]] = {}
        self.order: list[tuple[bytes, int, int, int]] = []
        while i < len(raw):
            frame, offset, size_, n = struct.unpack_from("<IIIH", raw, i)
            name = raw[i + 14 : i + 14 + n]
            self.index[name] = (frame, offset, size_)
            self.order.append((name, frame, offset, size_))
            i += 14 + n

    def frame(self, number: int) -> bytes:
        at, packed, raw = self.frames[number]
        return self.decompressor.decompress(self.read(at, packed), max_output_size=max(raw, 1))

    def record(self, identifier: bytes) -> bytes:
        frame, offset, size = self.index[identifier]
        return self.frame(frame)[offset : offset + size]

    def __iter__(self):
        held, body = None, b""
        for name, frame, offset, size in self.order:
            if frame != held:
                held, body = frame, self.frame(frame)
            yield name, body[offset : offset + size]


def identifier(page_id: int | None, digest: str, copy: int = 0) -> str:
    """Name of a record: its row's id, its payload and, for a row that repeats within a bundle, a number."""
    return f"urn:kb:page:{'none' if page_id is None else page_id}:{digest[:16]}" + f":{copy}" * bool(copy)


def _page_of(name: str) -> int | None:
    page = name.split(":")[3]
    return None if page == "none" else int(page)


def warc_record(page_id, url, payload: bytes, digest: str, refers_to=None, copy: int = 0) -> bytes:
    """A WARC/1.1 response, or, with refers_to, a revisit without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{identifier(page_id, digest, copy)}>",
        f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}"]),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([] if refers_to is None else [f"WARC-Refers-To: <{identifier(refers_to, digest)}>", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of a record; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload doesn't fit its digest")
    refers = fields.get("WARC-Refers-To")
    return {
        "page_id": _page_of(fields["WARC-Record-ID"].strip("<>")),
        "url": unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None,
        "payload": payload if kind == "response" else None,
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page_of(refers.strip("<>")) if refers else None,
    }


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> DataFrame:
    """Writes every row to bundles in the folder; gives the manifest (path, size, records), written beside them."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= least).select("page_id", "digest")
    firsts = stored(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "firsts")
    others = stored(large.join(firsts, "digest").where("not (page_id <=> first)").select("page_id", "digest", "first").distinct(), "revisits")
    joined = rows.join(others, rows["page_id"].eqNullSafe(others["page_id"]) & (rows["digest"] == others["digest"]), "left").select(rows["page_id"], "url", "payload", rows["digest"], "first")

    def run(batches):
        store, base = pafs.FileSystem.from_uri(folder)
        writer, n, made, copies = BundleWriter(), 0, [], {}

        def close():
            name = f"{base}/{uuid.uuid4().hex}.warc.zst"
            body = writer.to_bytes()
            with store.open_output_stream(name, compression=None) as f:
                f.write(body)
            made.append((name, len(body), n))

        store.create_dir(base, recursive=True)
        for batch in slices(batches, "payload"):
            for page_id, url, raw, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                copy = copies.get((page_id, digest), 0)
                copies[page_id, digest] = copy + 1
                writer.add(identifier(page_id, digest, copy).encode(), warc_record(page_id, url, raw, digest, first, copy))
                n += 1
            if writer.size >= BUNDLE:
                close()
                writer, n, copies = BundleWriter(), 0, {}
        if n:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], ["path", "size", "records"])

    return stored(joined.mapInArrow(run, "path string, size bigint, records bigint"), "manifest")


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of all records of the bundles."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 7 if with_payload else 6]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, size in zip(column(batch, "path").to_pylist(), column(batch, "size").to_pylist()):
                with store.open_input_file(path) as f:
                    held: list[dict] = []
                    for _, raw in BundleReader(lambda at, n: f.read_at(n, at), size):
                        held.append(parse_record(raw))
                        if len(held) == 1000 or len(raw) > FRAME:
                            yield pa.RecordBatch.from_arrays([pa.array([h[x] for h in held], k) for x, k in zip(names, kinds)], names)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array([h[x] for h in held], k) for x, k in zip(names, kinds)], names)

    n = max(1, manifest.count())
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * with_payload
    return manifest.select("path", "size").repartition(n, "path").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """All rows written to archives in the shared folder and read back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder, with_payload=False)
