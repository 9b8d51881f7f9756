"""Deterministic sharded WARC writer, and a reader.

Records are range-sorted by page id, so shards are runs of ids. A shard rolls to
a new file when the compressed size of the last one reaches `roll_bytes`; every
record is a gzip member of its own. Headers, record ids and digests are made
anew from the pages alone: the same table and number of partitions give the same
bytes. Files get temporary names until they are complete, and only files that the
manifest (a Parquet table, committed last) names belong to the archive.

Of pages with equal payloads the one with the largest id is the response and the
others are revisits, from `min_revisit` bytes on. Which page answers for which is
found on digests alone; its rows are then sent along with the pages in the one
shuffle that moves payloads.

Defined results: a null html is an empty payload; a null url gives a record
without target; rows that repeat a page id are separate records, all responses if
theirs is the largest id of the payload; a page without id is a revisit if a page
with one has its payload, else a response; an empty table gives an archive without
files. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm.common import slices
from changelens.llm.storage import committed, opened

# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
RECORD_SPACE = uuid.UUID("8c1f1c54-6d0e-5d55-9a53-1c0b3f6a2b11")
DATE = "2000-01-01T00:00:00Z"

_LENGTH = re.compile(rb"(?im)^content-length: *([0-9]+) *\r?$")
MANIFEST = "file string, records long, bytes long, sha1 string"


def digest(data: bytes) -> str:
    """Base32 SHA-1, upper case, without a prefix."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None, repeat: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(RECORD_SPACE, f'{page}/{repeat}')}>"


def _clean(value: str) -> str:
    """A header value without control characters."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{name}: {value}\r\n" for name, value in headers]
    head = VERSION + "".join(lines).encode("utf-8", "replace") + f"Content-Length: {len(block)}\r\n\r\n".encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def page_record(page: int | None, repeat: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The gzip member of a page."""
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page, repeat)),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", _clean(url))] if url is not None else []),
        *([("X-Page-ID", str(page))] if page is not None else []),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    block = HTTP.format(len(payload)).encode()
    if refers_to is None:
        block += payload
    else:
        headers += [
            ("WARC-Refers-To", record_id(refers_to)),
            ("X-Refers-To-Page-ID", str(refers_to)),
            ("WARC-Profile", PROFILE),
        ]
    headers.append(("WARC-Block-Digest", f"sha1:{digest(block)}"))
    return _record(headers, block)


def _info(name: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    headers = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(RECORD_SPACE, name)}>"),
        ("WARC-Date", DATE),
        ("WARC-Filename", name),
        ("Content-Type", "application/warc-fields"),
    ]
    return _record(headers, block)


def _with_responses(pages: DataFrame, min_revisit: int) -> DataFrame:
    """page_id, url, html, refers_to. Rows with the page a payload refers to come first
    among those of a page id; `_joined` puts the two together."""
    given = pages.select("page_id", "url", "html")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    prints = given.select("page_id", F.sha1(payload).alias("sha1"), F.length(payload).alias("size"))
    last = prints.where(F.col("size") >= min_revisit).groupBy("sha1", "size").agg(
        F.max("page_id").alias("response"), F.count(F.lit(1)).alias("rows")
    ).where("rows > 1")
    refers = prints.join(last, ["sha1", "size"]).where(~F.col("page_id").eqNullSafe(F.col("response")))
    refers = refers.where("response is not null").select("page_id", "sha1", "response").distinct()
    none = F.lit(None)
    return given.select(
        F.lit(1).alias("order"), "page_id", "url", "html", none.cast("string").alias("sha1"), none.cast("long").alias("response")
    ).union(
        refers.select(F.lit(0), "page_id", none.cast("string"), none.cast("string"), "sha1", "response")
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in slices(batches):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def write_archive(pages: DataFrame, folder: str, roll_bytes: int = 256 << 20, min_revisit: int = 0) -> DataFrame:
    """Write the pages below `folder` and give the manifest (file, records, bytes, sha1)."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part = TaskContext.get().partitionId(), 0
        records = _records(batches)
        member = next(records, None)
        while member is not None:
            name = f"part-{shard:05d}-{part:05d}.warc.gz"
            count, size, sha1 = 0, 0, hashlib.sha1()
            with committed(folder, name) as stream:
                data = _info(name)
                while True:
                    stream.write(data)
                    sha1.update(data)
                    size += len(data)
                    if size >= roll_bytes or member is None:
                        break
                    data, member = member, next(records, None)
                    count += 1
            part += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([count]), pa.array([size]), pa.array([sha1.hexdigest()])],
                ["file", "records", "bytes", "sha1"],
            )

    def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for page, rows in groupby(_rows(batches), key=lambda r: r[1]):
            refers: dict[str, int] = {}
            repeat = 0
            for order, _, url, html, sha1, response in rows:
                if order == 0:
                    refers[sha1] = response
                else:
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    to = refers.get(hashlib.sha1(payload).hexdigest()) if refers else None
                    yield page_record(page, repeat, url, payload, to)
                    repeat += 1

    rows = _with_responses(pages, min_revisit)
    ordered = rows.repartitionByRange("page_id").sortWithinPartitions("page_id", "order", "url", F.sha1("html"))
    path = f"{folder.rstrip('/')}/_manifest"
    ordered.mapInArrow(files, MANIFEST).write.parquet(path)
    return pages.sparkSession.read.parquet(path)


_READ, _FEED = 1 << 20, 1 << 14


def _members(stream: pa.NativeFile) -> Iterator[bytes]:
    """The decompressed gzip members of a file, one at a time. A member is fed in small
    pieces, so what is left over at its end, and copied, is small."""
    data, at = memoryview(b""), 0
    while True:
        reader, parts = zlib.decompressobj(31), []
        while not reader.eof:
            if at == len(data):
                data, at = memoryview(stream.read(_READ)), 0
                if not len(data):
                    if parts:
                        raise ValueError("the file ends inside a record")
                    return
            piece = data[at : at + _FEED]
            parts.append(reader.decompress(piece))
            at += len(piece) - len(reader.unused_data)
        yield b"".join(parts)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if first + b"\r\n" != VERSION:
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    headers = {}
    for line in lines:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        headers[name.lower()] = value.strip()
    length = int(headers["content-length"])
    if len(rest) != length + 4:
        raise ValueError("a record's length differs from its header")
    return headers, rest[:length]


RECORDS = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload string"


def read_archive(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """page_id, url, record_type, payload_digest, refers_to, payload (null for revisits, or
    a null column) and payload_bytes of all records that the manifest names, in one reading;
    digests are checked. A revisit holds the response's headers, which state the length."""
    names = spark.read.parquet(f"{folder.rstrip('/')}/_manifest").select("file")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with opened(folder, name) as stream:
                    held: list[tuple] = []
                    size = 0
                    for member in _members(stream):
                        row = _row(*parse_record(member))
                        if row:
                            held.append(row)
                            size += len(row[5] or b"") if with_payload else 100
                        if size > 4 << 20:
                            yield _batch(held)
                            held, size = [], 0
                    if held:
                        yield _batch(held)

    def _row(headers: dict[str, str], block: bytes) -> tuple | None:
        kind = headers["warc-type"]
        if kind == "warcinfo":
            return None
        if headers["warc-block-digest"] != f"sha1:{digest(block)}":
            raise ValueError(f"damaged block of {headers['warc-record-id']}")
        stated = headers["warc-payload-digest"].removeprefix("sha1:")
        head, _, payload = block.partition(b"\r\n\r\n")
        size = int(_LENGTH.search(head)[1])
        if kind == "response" and (len(payload) != size or digest(payload) != stated):
            raise ValueError(f"damaged payload of {headers['warc-record-id']}")
        page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
        return (
            None if page is None else int(page),
            headers.get("warc-target-uri"),
            kind,
            stated,
            None if refers is None else int(refers),
            payload if with_payload and kind == "response" else None,
            size,
        )

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        arrays[5] = arrays[5].cast(pa.string())
        return pa.RecordBatch.from_arrays(
            arrays, ["page_id", "url", "record_type", "payload_digest", "refers_to", "payload", "payload_bytes"]
        )

    # By ranges of the name each file is a partition of its own.
    files = names.repartitionByRange(max(1, names.count()), "file")
    return files.mapInArrow(records, f"{RECORDS}, payload_bytes long")
