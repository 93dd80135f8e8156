"""WARC archives as a Spark data source: a committing writer and a splittable reader.

``df.write.format("warc")`` writes gzip-per-record WARC 1.1 files.  A task writes
under a hidden name; the driver's commit renames the files of the attempts that
count, so lost or repeated attempts leave nothing behind that is read.

``spark.read.format("warc")`` cuts every archive into byte ranges.  A task scans
its range for the gzip magic, takes a candidate as a record only if it decodes to
a WARC header, and owns exactly the records that *start* inside the range; the
last one may end beyond it.  Memory is one record and one read buffer.

A payload may itself hold gzip members with WARC headers, which deflate stores
verbatim when they do not compress.  So a candidate counts only if it is *proven*:
it starts the file, or the members from it on follow each other without a gap up to
the end of the file or for more than a stored deflate block can hold (65,535
bytes), or a proven chain of members that starts before it arrives at it.  Whether
a place is proven depends on the file alone, so every way to cut it into ranges
gives the same records.

Paths are URIs that pyarrow's file systems open (shared mounts, HDFS, object
stores).

Defined results
* Null payload: empty.  Null target URI: the record has none.
* A record with ``refers_to`` is a revisit: it keeps the HTTP header, with the
  payload's length, and the payload's digest, but not the payload.
* Control characters in URIs are percent-encoded, so a header cannot be forged.
* Damaged members are passed over; reading goes on at the next proven record.
* No archives in the folder: no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from wattline.llm.text import free, settle

MAGIC = b"\x1f\x8b\x08"
READ = 1 << 18
MOVES = 32
HEADER_LIMIT = 1 << 20
#: Most bytes that a stored block of deflate can hold.
STORED = (1 << 16) - 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

WRITE_FIELDS = ("record_id", "target_uri", "payload", "refers_to")
READ_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, file string, offset long"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(uri: str) -> str:
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in uri)


def record(record_id: str, target_uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One uncompressed response or revisit record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_clean(record_id)}>", f"WARC-Date: {DATE}"]
    if target_uri is not None:
        head.append(f"WARC-Target-URI: {_clean(target_uri)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_clean(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member, with no time stamp, so that equal records give equal bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, max_bytes: int):
        self.path, self.max_bytes = path, max_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            ids, uris, payloads, refers = (batch.column(batch.schema.get_field_index(f)) for f in WRITE_FIELDS)
            for i in range(batch.num_rows):
                if out is None:
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{root}/_{files[-1]}", compression=None), 0
                data = member(record(ids[i].as_py(), uris[i].as_py(), payloads[i].as_py() or b"", refers[i].as_py()))
                out.write(data)
                size += len(data)
                if size >= self.max_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        names = [f for m in messages if m for f in m.files]
        with ThreadPoolExecutor(MOVES) as pool:  # a move is a copy on some stores
            list(pool.map(lambda name: fs.move(f"{root}/_{name}", f"{root}/{name}"), names))

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for name in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{root}/_{name}")


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


class _Window:
    """Forward reads of a file through one buffer."""

    def __init__(self, file):
        self.file, self.at, self.data = file, 0, b""

    def read(self, at: int, n: int = READ) -> bytes:
        if not (self.at <= at < self.at + len(self.data)):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(n)
        return self.data[at - self.at :]


def _next_magic(window: _Window, at: int, end: int) -> int | None:
    """The first place of the gzip magic in [at, end), which may reach over end."""
    while at < end:
        data = window.read(at)
        if len(data) < len(MAGIC):
            window.data = b""
            data = window.read(at)
            if len(data) < len(MAGIC):
                return None
        found = data.find(MAGIC)
        if found >= 0:
            return at + found if at + found < end else None
        at += len(data) - len(MAGIC) + 1
    return None


def _headers(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.split(b":", 1) for x in lines if b":" in x)
    return {k.strip().lower().decode("ascii", "replace"): v.strip().decode("utf-8", "replace") for k, v in pairs}


def _decode(window: _Window, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """(WARC headers, block, end of the member), or None if no record starts here."""
    unpack, out, pos, head_end = zlib.decompressobj(31), bytearray(), at, -1
    try:
        while not unpack.eof:
            data = window.read(pos)
            if not data:
                return None
            out += unpack.decompress(data)
            pos += len(data) - len(unpack.unused_data)
            if head_end < 0:
                if not b"WARC/1.".startswith(bytes(out[:7])):
                    return None
                head_end = out.find(b"\r\n\r\n")
                if head_end < 0 and len(out) > HEADER_LIMIT:
                    return None
    except zlib.error:
        return None
    if head_end < 0:
        return None
    head = _headers(bytes(out[:head_end]).split(b"\r\n")[1:])
    if not head.get("content-length", "").isdigit():
        return None
    start, n = head_end + 4, int(head["content-length"])
    if len(out) < start + n:
        return None
    return head, bytes(memoryview(out)[start : start + n]), pos


def _member_end(window: _Window, at: int) -> int | None:
    """Where the gzip member at ``at`` ends, or None if there is no whole one."""
    unpack, pos = zlib.decompressobj(31), at
    try:
        while not unpack.eof:
            data = window.read(pos)
            if not data:
                return None
            rest = data
            while rest and not unpack.eof:
                unpack.decompress(rest, READ)
                rest = unpack.unconsumed_tail
            pos += len(data) - len(unpack.unused_data)
    except zlib.error:
        return None
    return pos


def _proven_ahead(window: _Window, at: int, size: int) -> bool:
    end = at
    while end - at <= STORED:
        after = _member_end(window, end)
        if after is None:
            return False
        end = after
        if end == size:
            return True
    return True


def _proven(window: _Window, at: int, size: int) -> bool:
    """True if a proven chain of members starts at or arrives at ``at``.

    Looks back in ever longer steps, only where looking ahead does not settle it.
    """
    if at == 0 or _proven_ahead(window, at, size):
        return True
    back = 2 * STORED
    while True:
        start = max(0, at - back)
        place = 0 if start == 0 else _next_magic(window, start, at)
        while place is not None and place < at:
            end = _member_end(window, place)
            if end is not None and (place == 0 or _proven_ahead(window, place, size)):
                while end is not None and end < at:
                    end = _member_end(window, end)
                if end is not None:
                    return end == at
            place = _next_magic(window, place + 1, at)
        if start == 0:
            return False
        back *= 4


def records(fs: pafs.FileSystem, path: str, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records that start in [start, end)."""
    with fs.open_input_file(path) as file:
        window, at, size, linked = _Window(file), start, file.size(), start == 0
        while (found := _next_magic(window, at, end)) is not None:
            linked = linked and found == at
            got = _decode(window, found)
            if got is not None and (linked or _proven(window, found, size)):
                yield found, got[0], got[1]
                at, linked = got[2], True
                continue
            after = _member_end(window, found) if linked else None
            at, linked = (found + 1, False) if after is None else (after, True)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, payloads: bool):
        self.path, self.split_bytes, self.payloads = path, split_bytes, payloads

    def partitions(self) -> list[ByteRange]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        files = [f for f in found if f.is_file and f.base_name.endswith(".warc.gz") and f.base_name[0] not in "._"]
        return [ByteRange(f.path, a, min(a + self.split_bytes, f.size)) for f in files for a in range(0, f.size, self.split_bytes)]

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no archives
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())])
        rows, size = [], 0
        for at, head, block in records(fs, partition.path, partition.start, partition.end):
            rows.append(self._row(at, head, block, partition.path))
            size += len(block)
            if len(rows) >= 1000 or size >= 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _row(self, at: int, head: dict[str, str], block: bytes, path: str) -> dict:
        kind, given = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        http, _, payload = block.partition(b"\r\n\r\n")
        if kind == "revisit":
            length = _headers(http.split(b"\r\n")[1:]).get("content-length", "")
            n, payload = int(length) if length.isdigit() else None, None
        else:
            n, found = len(payload), digest(payload)
            if given is not None and given != found:
                raise ValueError(f"{path} at {at}: payload digest is {found}, header says {given}")
            given = found
        return {
            "record_id": head.get("warc-record-id", "").strip("<>"),
            "record_type": kind,
            "target_uri": head.get("warc-target-uri"),
            "refers_to": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None,
            "payload_bytes": n,
            "payload_digest": given,
            "payload": payload if self.payloads else None,
            "file": path,
            "offset": at,
        }


class WarcSource(DataSource):
    """Options: path, maxBytes (archive size when writing), splitBytes, payloads."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], int(self.options.get("splitBytes", 32 << 20)), self.options.get("payloads", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("warc archives are only added: use mode append")
        return WarcWriter(self.options["path"], int(self.options.get("maxBytes", 1 << 30)))


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Adds refers_to: the least id with the same payload, null on that row itself.

    Payloads under ``min_bytes`` and rows with a null id never refer to another.
    The least id is found with a map-side combine by SHA-256, and reaches the pages
    by a shuffled join whose hot keys adaptive execution can split.
    """
    key = F.sha2(F.coalesce(F.col(payload_col), F.lit("")).cast("binary"), 256)
    big = F.octet_length(F.coalesce(F.col(payload_col), F.lit(""))) >= min_bytes
    sha, least = free("_key", pages), free("_first", pages)
    first = settle(pages.where(big).groupBy(key.alias(sha)).agg(F.min(id_col).alias(least)))
    joined = pages.join(first, key == F.col(sha), "left")
    again = F.when(big & (F.col(id_col) > F.col(least)), F.col(least))
    return joined.withColumn("refers_to", again).drop(sha, least)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> None:
    """A response or revisit record per row of ``pages``, in new archives under ``path``."""
    pages.sparkSession.dataSource.register(WarcSource)
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    rows = with_revisits(narrow, min_bytes=min_bytes).select(
        urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.col("html").cast("binary").alias("payload"),
        F.when(F.col("refers_to").isNotNull(), urn(F.col("refers_to"))).alias("refers_to"),
    )
    rows.write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True, split_bytes: int = 32 << 20) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payloads", str(payloads).lower()).option("splitBytes", split_bytes).load(path)


def page_id(urn) -> F.Column:
    """The id in a record's URN; null for the record of a null id."""
    return F.nullif(F.regexp_extract(urn, r"^urn:page:(.*)$", 1), F.lit("")).cast("long")
