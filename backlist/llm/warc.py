"""WARC archives: a deduplicating writer and a sequential reader.

Writer: one gzip member per record, in files of about ``FILE_BYTES``.  Pages
with equal payloads (SHA-1 and length) are one response, the page with the
largest id, and revisits that refer to it.  Every task attempt writes files
of its own and returns their names; only the files named in the committed
manifest are read, so a lost executor or a repeated task leaves no doubles.

Reader: each file is read in order with constant memory per record.  Bytes
are fed to an incremental decompressor, a member's end ends the record, the
record header's Content-Length frames the block, and block and payload
digests are verified; any disagreement is an error that names file and record.

Defined cases: a null or empty payload is a record of no bytes, and such
records count as equal; pages with the same id and payload as the response
are responses too; pages without id have no record id of their own and come
back with a null id; null url is empty; a very long payload is held whole, once,
while its record is written or read; an empty table writes no file and reads no
row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backlist.llm.common import blocks, encoded, map_arrow, materialize
from backlist.session import shared_dir

FILE_BYTES = 256 << 20
READ_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages have no fetch time
_LINE_BREAKS = re.compile(r"[\r\n]+")


def sha1_text(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _page_of(name: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+|none)>", name)
    if not m:
        raise ValueError(f"record id {name!r}")
    return None if m[1] == "none" else int(m[1])


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit's block is the HTTP header alone."""
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {_LINE_BREAKS.sub(' ', url)}",
            "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
            f"WARC-Block-Digest: sha1:{sha1_text(block)}", f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(f: BinaryIO) -> Iterator[bytes]:
    """The contents of a file's gzip members, one after the other."""
    z, parts, data = None, [], b""
    while True:
        if not data:
            data = f.read(READ_BYTES)
            if not data:
                if z is not None:
                    raise ValueError("the file ends within a gzip member")
                return
        z = z or zlib.decompressobj(31)
        parts.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = None, []


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and the block of one record."""
    head, end, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not end or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"a block of {size} bytes isn't followed by two line breaks")
    if fields.get("warc-block-digest", f"sha1:{sha1_text(rest[:size])}") != f"sha1:{sha1_text(rest[:size])}":
        raise ValueError("block digest")
    return fields, rest[:size]


def page_of(fields: dict[str, str], block: bytes) -> tuple:
    """``(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to)``."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind, refers = fields["warc-type"], None
    if kind == "response":
        if len(payload) != size or sha1_text(payload) != digest:
            raise ValueError("payload length or digest")
    elif kind == "revisit":
        payload, refers = None, _page_of(fields["warc-refers-to"])
    else:
        raise ValueError(f"record type {kind!r}")
    return _page_of(fields["warc-record-id"]), fields["warc-target-uri"], payload, size, digest, kind, refers


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages(page_id, url, html)`` as archives under ``folder`` (a
    place that every executor reaches) and returns their manifest
    ``(file, records)``."""
    p = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                     F.coalesce("html", F.lit("")).alias("html"))
    p = p.select("*", F.sha1(F.col("html").cast("binary")).alias("sha1"), F.octet_length("html").alias("size"))
    # the response of each payload; a digest's rows are combined before the shuffle,
    # and written, so that both sides of the join come straight from a shuffle and
    # the pages of a hot payload can be split
    first = materialize(p.where(F.col("size") >= min_bytes).groupBy("sha1", "size")
                        .agg(F.max("page_id").alias("response_id")), "warc-responses")
    dealt = p.join(first, ["sha1", "size"], "left").select(
        "page_id", "url", "html", F.coalesce("response_id", "page_id").alias("response_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, file, size, n, done = None, "", 0, 0, []
        for b in blocks(batches, "html"):
            for page_id, url, html, response in zip(b.column(0).to_pylist(), b.column(1).to_pylist(),
                                                    encoded(b.column(2)), b.column(3).to_pylist()):
                if out is None:
                    file, size, n = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    store, path = _open(file)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path, compression=None)
                member = gzip_member(record(page_id, url, html, sha1_text(html), response, page_id != response))
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    done.append((file, n))
        if out is not None:
            out.close()
            done.append((file, n))
        for file, n in done:
            yield pa.RecordBatch.from_pydict({"file": [file], "records": [n]})

    return materialize(map_arrow(dealt, run, "file string, records long"), "warc-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """All records of the manifest's files: ``(page_id, url, html,
    payload_bytes, payload_digest, record_type, refers_to)``; a revisit's html
    is null."""
    names = ["page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    schema = "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                store, path = _open(file)
                rows, held, seen = [], 0, 0
                with store.open_input_stream(path, compression=None) as f:
                    for data in members(f):
                        try:
                            row = page_of(*parse(data))
                        except (ValueError, KeyError, TypeError) as e:
                            raise ValueError(f"{file}, record {seen}: {e}") from e
                        seen, held = seen + 1, held + len(data)
                        rows.append((*row[:2], None if row[2] is None else row[2].decode(), *row[3:]))
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield batch(rows)
                            rows, held = [], 0
                if seen != n:
                    raise ValueError(f"{file} has {seen} records; its manifest says {n}")
                if rows:
                    yield batch(rows)

    # as many parts as files: a number that is given isn't merged, and ranges of
    # distinct names hold one file each
    files = manifest.select("file", "records").repartitionByRange(max(manifest.count(), 1), "file")
    return map_arrow(files, run, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` written as archives in the shared folder and read back."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return read(write(pages, folder, min_bytes))
