"""WARC archives: writing pages as records, and normalising monolithic gzip archives.

A monolithic archive is one gzip stream over many records, so that no record can be read by itself. The normaliser
inflates each such stream once, in pieces, writes every record again as a gzip member of its own, and lists the
members' offsets in a sidecar index. A reader then seeks to the members it needs.

Tasks write files under names of their own and return them; only what successful tasks returned is read on.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hubs import with_hubs
from .scratch import Scratch

#: Bytes of records after which a task begins another archive, and bytes that are inflated at a time.
FILE_BYTES = 64_000_000
PIECE_BYTES = 1 << 20
#: Tasks for archives and for reading records back at most; more archives share tasks.
MOST_TASKS = 10_000
#: Payloads shorter than this are stored again rather than referred to.
LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _header_text(value: str) -> str:
    """A header's value must stay on its line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the response's HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_text(url)}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers_of(raw: bytes) -> dict[str, str]:
    head = raw.split(b"\r\n\r\n", 1)[0].decode("utf-8", "replace").split("\r\n")
    return {"version": head[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}


def split_records(pieces: Iterator[bytes], name: str = "archive") -> Iterator[bytes]:
    """The records of a gzip archive of one or more members, inflated once; never more than a record and a piece are held."""
    inflate, held, begun = zlib.decompressobj(31), bytearray(), False
    size = None

    def ready() -> Iterator[bytes]:
        nonlocal size
        while True:
            if size is None:
                if (at := held.find(b"\r\n\r\n")) < 0:
                    return
                if not held.startswith(b"WARC/"):
                    raise ValueError(f"{name}: no WARC record where one should begin")
                size = at + 4 + int(headers_of(bytes(held[: at + 4])).get("content-length", 0)) + 4
            if len(held) < size:
                return
            yield bytes(held[:size])
            del held[:size]
            size = None

    for piece in pieces:
        while piece:
            begun = True
            held += inflate.decompress(piece, PIECE_BYTES)
            yield from ready()
            piece = inflate.unconsumed_tail
            if inflate.eof:
                piece, inflate, begun = inflate.unused_data, zlib.decompressobj(31), False
    if begun or held:
        raise ValueError(f"{name}: the archive ends within a record")


def _pieces(stream) -> Iterator[bytes]:
    while piece := stream.read(PIECE_BYTES):
        yield piece


def _member(raw: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """``path`` of each monolithic archive written from ``page_id, url, payload, digest, size, refers_to``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        paths, out, pack, n = [], None, None, 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                if out is None:
                    paths.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, pack, n = fs.open_output_stream(f"{root}/{paths[-1]}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0
                raw = record(*(x.as_py() for x in row))
                out.write(pack.compress(raw))
                n += len(raw)
                if n >= FILE_BYTES:
                    out.write(pack.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(pack.flush())
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{p}" for p in paths], pa.string())], names=["path"])

    return records.select("page_id", "url", "payload", "digest", "size", "refers_to").mapInArrow(run, "path string")


INDEX = "path string, offset bigint, length bigint, type string, page_id bigint, record_id string, uri string"


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """The index (INDEX) of the archives written again, one gzip member for each record, from ``archives(path)``.

    Each archive is one task's work, since its stream can't be entered midway; memory stays at one record. The same
    index lies beside each file as ``.cdxj``, a JSON object a line. A broken archive raises an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        names = ["path", "offset", "length", "type", "page_id", "record_id", "uri"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source, inner = FileSystem.from_uri(path)
                name, at = uuid.uuid4().hex, 0
                rows: list[tuple] = []
                with source.open_input_stream(inner, compression=None) as stream, fs.open_output_stream(f"{root}/{name}.warc.gz", compression=None) as out, fs.open_output_stream(f"{root}/{name}.cdxj", compression=None) as index:
                    for raw in split_records(_pieces(stream), path):
                        head, packed = headers_of(raw), _member(raw)
                        page = head.get("x-page-id")
                        rows.append((f"{folder}/{name}.warc.gz", at, len(packed), head.get("warc-type"), None if page is None else int(page), head.get("warc-record-id"), head.get("warc-target-uri")))
                        index.write((json.dumps(dict(zip(names[1:], rows[-1][1:], strict=True))) + "\n").encode())
                        out.write(packed)
                        at += len(packed)
                        if len(rows) >= 5_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    tasks = min(max(1, archives.count()), MOST_TASKS)
    return archives.select("path").repartition(tasks).mapInArrow(run, INDEX)


def read_records(index: DataFrame) -> DataFrame:
    """Each indexed record by a seek to its member: ``page_id, type, refers_to, uri, payload, payload_bytes, payload_digest``.

    A response's size and digest are taken from its payload and must agree with its headers. A revisit has no
    payload of its own; its size and digest are those of the response it refers to, as its headers give them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, stream = None, None
        for batch in batches:
            out = []
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != held:
                    fs, inner = FileSystem.from_uri(path)
                    held, stream = path, fs.open_input_file(inner)
                stream.seek(offset)
                raw = zlib.decompress(stream.read(length), 31)
                head, (_, block) = headers_of(raw), raw[:-4].split(b"\r\n\r\n", 1)
                http, payload = block.split(b"\r\n\r\n", 1)
                size, digest = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1]), head["warc-payload-digest"].removeprefix("sha256:")
                if head["warc-type"] == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                    raise ValueError(f"{path}: the record at {offset} doesn't match its digest")
                number = lambda k, head=head: int(head[k]) if k in head else None
                out.append((number("x-page-id"), head["warc-type"], number("x-refers-to-page-id"), head.get("warc-target-uri"), payload if head["warc-type"] == "response" else None, size, digest))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string()]
            columns = zip(*out, strict=True) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["page_id", "type", "refers_to", "uri", "payload", "payload_bytes", "payload_digest"])

    slim = index.select("path", "offset", "length")
    return slim.mapInArrow(run, "page_id bigint, type string, refers_to bigint, uri string, payload binary, payload_bytes bigint, payload_digest string")


def page_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, payload, digest, size, refers_to``: what ``write_archives`` takes.

    Of equal payloads of ``least`` bytes or more that with the smallest page_id is the response, which the others
    refer to; smaller ones are never revisits. Null html is an empty payload. Rows with that smallest id are all
    responses. A null id is a revisit where another row of its payload has an id. Empty tables give no rows; html is
    taken whole, however long; other columns are ignored. Ids are integers.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.length("payload").cast("long"))
    slim = pages.select("page_id", payload.alias("payload")).select("page_id", F.sha2("payload", 256).alias("digest"), F.length("payload").alias("size"))
    first = slim.groupBy("digest").agg(F.min(F.when(F.col("size") >= least, F.col("page_id"))).alias("first"), F.count("*").alias("n"))
    met = with_hubs(rows, first, "digest", pages.count())  # a payload may be that of any share of the pages
    return met.withColumn("refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first")).when(F.col("page_id").isNull(), F.col("first"))).drop("first")


def archive_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Writes monolithic archives of ``pages(page_id, url, html)``, normalises them, and returns the index and the records read back.

    Each page is one record, as ``page_records`` says; no pages give no records and no archives."""
    scratch = Scratch(pages.sparkSession)
    archives = scratch.save(write_archives(page_records(pages), f"{scratch.dir}/warc"), "archives")
    index = scratch.save(normalise(archives, f"{scratch.dir}/normal"), "index")
    tasks = min(max(1, archives.count()), MOST_TASKS)
    return index, read_records(index.repartitionByRange(tasks, "path", "offset"))
