"""WARC records in ZIP packages, and a reader that range-reads them without extraction.

An archive is a ZIP file of stored members: records compressed one by one, and an index of their offsets. The reader takes the end
record, the ZIP64 locator and the central directory, finds the members, reads the index and then single ranges of the data member.

Packages are files in the shared folder where executors mount it. Where it is a store that only Spark reaches, which has no sink for plain
files, they are cells of a table, and the same reader ranges over a cell.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, map_batches, materialize, rows_of, shared_dir

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payloads in one archive, in bytes; payloads below MIN_DEDUP_BYTES are never revisits.
ARCHIVE_BYTES, MIN_DEDUP_BYTES = 8 << 20, 0
_LIMIT = 0xFFFFFFFF
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def write_zip(members: Iterable[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; zip64 writes the large forms whatever the sizes."""
    out, entries = bytearray(), []
    for name, data in members:
        raw, at, crc = name.encode(), len(out), zlib.crc32(data)
        large = zip64 or len(data) >= _LIMIT
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if large else b""
        size = _LIMIT if large else len(data)
        out += struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45 if large else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra + data
        entries.append((raw, crc, len(data), at))
    start = len(out)
    for raw, crc, n, at in entries:
        large = zip64 or n >= _LIMIT or at >= _LIMIT
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if large else b""
        size, offset = (_LIMIT, _LIMIT) if large else (n, at)
        out += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45 if large else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, offset) + raw + extra
    n, length = len(entries), len(out) - start
    if zip64 or n >= 0xFFFF or start >= _LIMIT:
        end = len(out)
        out += struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, length, start) + struct.pack("<4sIQI", b"PK\6\7", 0, end, 1)
        n, length, start = 0xFFFF, _LIMIT, _LIMIT
    out += struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, n, n, length, start, 0)
    return bytes(out)


class BytesRange:
    def __init__(self, data):
        self.data, self.size = memoryview(data), len(data)

    def read(self, at: int, n: int) -> bytes:
        return bytes(self.data[at : at + n])


class FileRange:
    """A file on a mounted path; reads only the ranges asked for."""

    def __init__(self, path: str):
        self.file = open(path, "rb", buffering=0)
        self.size = self.file.seek(0, 2)

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        parts = []
        while n > 0 and (part := self.file.read(n)):
            parts.append(part)
            n -= len(part)
        return b"".join(parts)

    def close(self) -> None:
        self.file.close()


class Package:
    """The members of a ZIP file, by its central directory."""

    def __init__(self, source):
        self.source = source
        tail_at = max(0, source.size - 65557)
        tail = source.read(tail_at, source.size - tail_at)
        at = tail.rfind(b"PK\5\6")
        if at < 0:
            raise ValueError("no end of central directory")
        n, length, start = struct.unpack("<10xHII", tail[at : at + 20])
        if n == 0xFFFF or _LIMIT in (length, start):
            where = source.read(tail_at + at - 20, 20)
            if where[:4] != b"PK\6\7":
                raise ValueError("no ZIP64 locator")
            end = source.read(struct.unpack("<8xQ4x", where)[0], 56)
            if end[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end of central directory")
            n, length, start = struct.unpack("<32xQQQ", end)
        raw, at, self.members = source.read(start, length), 0, {}
        for _ in range(n):
            if raw[at : at + 4] != b"PK\1\2":
                raise ValueError("bad central directory")
            method, crc, packed, size, n_name, n_extra, n_comment, offset = struct.unpack("<6x4xH4xIIIHHH8xI", raw[at : at + 46])
            name = raw[at + 46 : at + 46 + n_name].decode()
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, k = struct.unpack("<HH", extra[:4])
                if kind == 1:
                    values = iter(struct.unpack(f"<{k // 8}Q", extra[4 : 4 + k // 8 * 8]))
                    size = next(values) if size == _LIMIT else size
                    packed = next(values) if packed == _LIMIT else packed
                    offset = next(values) if offset == _LIMIT else offset
                extra = extra[4 + k :]
            self.members[name] = (offset, packed, size, method)
            at += 46 + n_name + n_extra + n_comment

    def start(self, name: str) -> int:
        """Where the bytes of a stored member begin: after its local header, whose lengths are its own."""
        offset, packed, size, method = self.members[name]
        if method or packed != size:
            raise ValueError(f"{name} is not stored")
        head = self.source.read(offset, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError("bad local header")
        return offset + 30 + sum(struct.unpack("<26xHH", head))

    def range(self, name: str, at: int, n: int) -> bytes:
        return self.source.read(self.start(name) + at, n)

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """Headers and block of each record that the index names, one range at a time."""
        start = self.start(DATA)
        for line in self.range(INDEX, 0, self.members[INDEX][2]).splitlines():
            entry = json.loads(line)
            yield parse_record(gzip.decompress(self.source.read(start + entry["offset"], entry["length"])))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """A response record, or a revisit of page ``refers_to``. A null url is left out; line ends in it are percent-encoded."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    http = _HTTP + str(len(payload)).encode() + b"\r\n\r\n"
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k: v for k, _, v in (x.partition(": ") for x in lines)}
    return fields, rest[: int(fields["Content-Length"])]


def read_back(fields: dict[str, str], block: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a response's figures come from its payload itself."""
    number = lambda x: None if x == "<urn:page:null>" else int(x[len("<urn:page:") : -1])
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    size = int(http.rpartition(b"Content-Length: ")[2]) if revisit else len(payload)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else base32_sha1(payload)
    return number(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], number(fields["WARC-Refers-To"]) if revisit else None


def roles(pages: DataFrame, min_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """The rows of ``pages`` (page_id, url, html) with refers_to: of equal payloads of ``min_bytes`` or more, rows other than those of
    the largest page_id refer to it. Payloads are compared by SHA-1; the pages are dealt by page_id, so copies meet only as digests."""
    raw = F.coalesce("html", F.lit("")).cast("binary")
    named = pages.select("page_id", F.sha1(raw).alias("digest"), F.octet_length(raw).alias("n"))
    rows = materialize(named.where(F.col("n") >= min_bytes).groupBy("digest", "page_id").agg(F.count("*").alias("k")))
    first = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("ids")).where("ids > 1").select("digest", "refers_to")
    again = rows.join(first, "digest").where("page_id <> refers_to OR page_id IS NULL").select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "refers_to")
    keyed = pages.select("page_id", "url", "html", F.sha1(raw).alias("__own"))
    again = materialize(again)
    joined = keyed.join(again, keyed["page_id"].eqNullSafe(again["__id"]) & (keyed["__own"] == again["__digest"]), "left")
    return joined.select("page_id", "url", "html", "refers_to")


def mounted(spark) -> str | None:
    """The shared folder as a path that every executor opens, or None if only Spark reaches it."""
    parts = urlsplit(shared_dir(spark))
    return unquote(parts.path) if parts.scheme in ("", "file") and parts.netloc in ("", "localhost") else None


def write_archives(pages: DataFrame, min_bytes: int = MIN_DEDUP_BYTES, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = True, folder: str | None = None) -> DataFrame:
    """Write packages of about ``archive_bytes`` of payload each; path, content of each: a file in ``folder``, a path that every executor
    mounts, or else the bytes. A file has a name of its own for each attempt of a task, and the table, written to the shared folder, names
    those of the attempts that count; what a lost executor left behind is in no table."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, lines, size = bytearray(), [], 0

        def finish() -> pa.RecordBatch:
            package = write_zip([(DATA, bytes(data)), (INDEX, "\n".join(lines).encode())], zip64)
            if folder is None:
                return batch_of([(None, package)], schema)
            path = f"{folder}/{uuid.uuid4().hex}.wacz"
            os.makedirs(folder, exist_ok=True)
            with open(path, "wb") as f:
                f.write(package)
            return batch_of([(path, None)], schema)

        for b in batches:
            for page_id, url, html, refers_to in rows_of(b):
                payload = (html or "").encode()
                packed = gzip.compress(record(page_id, url, payload, refers_to), 5, mtime=0)
                lines.append(json.dumps({"url": url, "offset": len(data), "length": len(packed)}))
                data += packed
                size += len(payload)
                if size >= archive_bytes:
                    yield finish()
                    data, lines, size = bytearray(), [], 0
        if lines:
            yield finish()

    return materialize(map_batches(roles(pages, min_bytes), run, "path string, content binary"))


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of a table of packages (path, content): a task reads
    a package's directory, its index and one record at a time."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                source, rows = FileRange(path) if path is not None else BytesRange(content.as_buffer()), []
                for r in Package(source).records():
                    rows.append(read_back(*r))
                    if len(rows) >= 1000:
                        yield batch_of(rows, schema)
                        rows = []
                yield batch_of(rows, schema)
                if path is not None:
                    source.close()

    return map_batches(archives.select("path", "content"), run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def read_files(spark, paths: list[str]) -> DataFrame:
    """As read_archives(), of package files on a path that every executor mounts."""
    named = spark.createDataFrame([(p, None) for p in paths], "path string, content binary").repartition(max(1, len(paths)))
    return read_archives(named)


def round_trip(pages: DataFrame, min_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """Write a record for each row and read the archives back.

    A null html is an empty payload, and empty payloads equal one another; rows that repeat a page_id and payload are alike; a null
    page_id comes after all others; a null url is left out of the record; a very long html is one record, however long. Other columns,
    whatever their names, are left out. An empty table gives none.
    """
    path = mounted(pages.sparkSession)
    return read_archives(write_archives(pages, min_bytes, folder=path and f"{path}/loomline/{uuid.uuid4().hex}"))


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
b AS (SELECT *, array_to_string(list_transform(string_split(h, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS bits,
  max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + list_sum(list_transform(range(0, 5), lambda k: substr(bits, (5 * i + k + 1)::INT, 1)::INT * (16 >> k::INT)))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM b"""
