"""``spark.read.format("wal1")``: WAL files as batches, and as records; and writing them.

A file is one task's work, read through Arrow's file systems, so that it may lie in any store these reach. A batch
can also be read alone by its byte range, which the index gives. However large a file or a partition is, a task holds
about FLUSH_RECORDS decoded records or FLUSH_BYTES of batches at a time, and one batch at least.
"""

from __future__ import annotations

import io
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, InputPartition

from ..functions.codec import Record, batch_head, decode_batch, encode_batch, wal_entry, wal_head, wal_spans
from ..schema import BATCH, RECORD

PATH_FIELD = "path string"
#: Decoded records, and bytes of their batches, at which rows leave a task.
FLUSH_RECORDS = 10_000
FLUSH_BYTES = 4 << 20
#: Bytes that are read from a file at a time, and batches at which a file is closed.
BUFFER = 1 << 20
FILE_BATCHES = 50_000


def _null_if_0(ms: int) -> int | None:
    """A timestamp of 0 says that there is none; such a batch is never pruned by time."""
    return ms or None


def batch_row(topic: str, partition: int, data: bytes, start: int, end: int) -> tuple:
    head, records = decode_batch(data)
    base, at = head["base_offset"], head["base_timestamp"]
    rows = [(base + r.offset_delta, at + r.timestamp_delta if at or r.timestamp_delta else None, r.key, r.value, [{"key": k, "value": v} for k, v in r.headers] or None) for r in records]
    return (topic, partition, base, base + head["last_offset_delta"], head["attributes"], _null_if_0(at), _null_if_0(head["max_timestamp"]), head["producer_id"], head["producer_epoch"], head["base_sequence"], head["crc"], start, end, rows)


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(BATCH)
    *flat, nested = zip(*rows, strict=True)
    item = schema.field("records").type.value_field
    own = zip(*(r for records in nested for r in records), strict=True) if any(nested) else [()] * item.type.num_fields
    items = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(own, item.type, strict=True)], fields=list(item.type))
    ends = pa.array([0, *accumulate(map(len, nested))], pa.int32())
    arrays = [pa.array(c, f.type) for c, f in zip(flat, schema, strict=False)]
    return pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(ends, items, type=schema.field("records").type)], schema=schema)


def arrow_batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of batches as they leave a task: a few at a time, by their records and bytes and not by their number."""
    held, records, size = [], 0, 0
    for row in rows:
        held.append(row)
        records += len(row[-1])
        size += row[-2] - row[-3]
        if records >= FLUSH_RECORDS or size >= FLUSH_BYTES or len(held) >= FLUSH_RECORDS:
            yield _arrow(held)
            held, records, size = [], 0, 0
    if held:
        yield _arrow(held)


def _listed(path: str) -> list[tuple[str, str]]:
    fs, root = FileSystem.from_uri(path)
    info = fs.get_file_info(root)
    if info.type == FileType.File:
        return [(path, root)]
    found = [f.path for f in fs.get_file_info(FileSelector(root, recursive=True)) if f.type == FileType.File and f.path.endswith(".wal")]
    return [(path, p) for p in sorted(found)]


class WalPartition(InputPartition):
    def __init__(self, base: str, path: str):
        self.base, self.path = base, path


class WalReader(DataSourceReader):
    def __init__(self, options: dict):
        self.base, self.topic, self.partition = options["path"], options.get("topic"), options.get("partition")

    def pushFilters(self, filters):
        """Equality on topic and partition skips batches before they are decoded."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("topic",), ("partition",)):
                setattr(self, f.attribute[0], str(f.value))
            yield f  # Spark tests the rows again

    def partitions(self):
        return [WalPartition(*x) for x in _listed(self.base)]

    def rows(self, partition: WalPartition) -> Iterator[tuple]:
        fs, _ = FileSystem.from_uri(partition.base)
        with fs.open_input_file(partition.path) as f:
            stream = io.BufferedReader(f, BUFFER)
            for topic, part, start, end in wal_spans(stream, f.size()):
                if self.topic in (None, topic) and self.partition in (None, str(part)):
                    yield batch_row(topic, part, stream.read(end - start), start, end)

    def read(self, partition: WalPartition) -> Iterator[pa.RecordBatch]:
        return arrow_batches(self.rows(partition))


#: Nanoseconds within which files may show up in another order than that of their times.
LAG = 60 * 10**9


class WalStreamReader(DataSourceStreamReader):
    """New files, each once, whatever their names.

    An offset is a time and the names of the files that are younger; all older files have been read. A file that shows
    up late is still read if no file younger by more than LAG came before it."""

    def __init__(self, options: dict):
        self.options = options

    def _times(self) -> dict[str, int]:
        fs, root = FileSystem.from_uri(self.options["path"])
        found = fs.get_file_info([path for _, path in _listed(self.options["path"])])
        return {f.path.removeprefix(root).lstrip("/"): f.mtime_ns for f in found}

    def initialOffset(self) -> dict:
        return {"before": 0, "seen": []}

    def latestOffset(self) -> dict:
        times = self._times()
        before = max([0, *times.values()]) - LAG
        return {"before": before, "seen": sorted(name for name, t in times.items() if t > before)}

    def partitions(self, start: dict, end: dict):
        _, root = FileSystem.from_uri(self.options["path"])
        old, new = set(start["seen"]), set(end["seen"])
        due = [name for name, t in self._times().items() if (t <= end["before"] or name in new) and t > start["before"] and name not in old]
        return [WalPartition(self.options["path"], f"{root}/{name}" if name else root) for name in sorted(due)]

    def read(self, partition: WalPartition) -> Iterator[pa.RecordBatch]:
        return WalReader(self.options).read(partition)


class WalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wal1"

    def schema(self):
        return BATCH

    def reader(self, schema):
        return WalReader(self.options)

    def streamReader(self, schema):
        return WalStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WalSource)


def records_of(batches: DataFrame) -> DataFrame:
    """The record relation of batches, without any Python."""
    r = F.explode("records").alias("r")
    return batches.select("topic", "partition", r).select("topic", "partition", "r.*").select(*RECORD.names)


INDEX = "path string, topic string, partition int, base_offset bigint, last_offset bigint, byte_start bigint, byte_end bigint, min_timestamp bigint, max_timestamp bigint, row_count bigint"


def write_wal(records: DataFrame, folder: str, *, batch_records: int = 1_000, file_bytes: int = 100 << 20, flushed_at: int = 0, broker_id: int = 0) -> DataFrame:
    """Writes records as WAL files of many topics, and returns the index of their batches.

    Records are dealt out by topic and partition and sorted by offset; a task closes a batch at ``batch_records`` or
    at a change of partition, and a file at ``file_bytes`` or FILE_BATCHES. Until it is closed, a file's entries lie in
    a temporary one, since its head counts them. Names are each task's own; what a failed task wrote is in no index.
    Evaluate the index once, into a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        names = ["path", "topic", "partition", "base_offset", "last_offset", "byte_start", "byte_end", "min_timestamp", "max_timestamp", "row_count"]
        types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
        spool = tempfile.SpooledTemporaryFile(FLUSH_BYTES)
        size, own, held, index = 0, None, [], []

        def close_batch() -> None:
            nonlocal size, held
            if held:
                times = [r["timestamp_ms"] for r in held if r["timestamp_ms"] is not None]
                base, at = held[0]["offset"], min(times, default=0)
                made = [Record(r["offset"] - base, (r["timestamp_ms"] if r["timestamp_ms"] is not None else at) - at, r["key"], r["value"], [(h["key"], h["value"]) for h in r["headers"] or ()]) for r in held]
                data = encode_batch(base, made, base_timestamp=at, max_timestamp=max(times, default=0))
                spool.write(wal_entry(*own, data))
                index.append((*own, base, held[-1]["offset"], spool.tell() - len(data), spool.tell(), min(times, default=None), max(times, default=None), len(held)))
                size += len(data)
                held = []

        def close_file() -> pa.RecordBatch:
            """Writes the file and gives its rows of the index."""
            nonlocal size
            path, name = [], f"{uuid.uuid4().hex}.wal"
            if index:
                with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(head := wal_head(flushed_at, broker_id, len(index)))
                    spool.seek(0)
                    shutil.copyfileobj(spool, out, BUFFER)
                path = [f"{folder}/{name}"] * len(index)
                index[:] = [(*row[:4], row[4] + len(head), row[5] + len(head), *row[6:]) for row in index]
            columns = zip(*index, strict=True) if index else [()] * (len(names) - 1)
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([path, *columns], types, strict=True)], names=names)
            spool.seek(0)
            spool.truncate()
            index.clear()
            size = 0
            return made

        with spool:
            for batch in batches:
                for at in range(0, batch.num_rows, 1_000):
                    for row in batch.slice(at, 1_000).to_pylist():
                        if (row["topic"], row["partition"]) != own or len(held) >= batch_records:
                            close_batch()
                            own = (row["topic"], row["partition"])
                            if size >= file_bytes or len(index) >= FILE_BATCHES:
                                yield close_file()
                        held.append(row)
            close_batch()
            yield close_file()

    dealt = records.select(*RECORD.names).repartition("topic", "partition").sortWithinPartitions("topic", "partition", "offset")
    return dealt.mapInArrow(run, INDEX)


def read_spans(index: DataFrame) -> DataFrame:
    """The batches that index rows point at, each by its byte range alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, stream = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != held:
                    fs, inner = FileSystem.from_uri(row["path"])
                    if stream:
                        stream.close()
                    held, stream = row["path"], fs.open_input_file(inner)
                stream.seek(row["byte_start"])
                data = stream.read(row["byte_end"] - row["byte_start"])
                if batch_head(data)["base_offset"] != row["base_offset"]:
                    raise ValueError(f"{held}: the index doesn't fit the file")
                yield batch_row(row["topic"], row["partition"], data, row["byte_start"], row["byte_end"])
        if stream:
            stream.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return arrow_batches(rows(batches))

    return index.select("path", "topic", "partition", "base_offset", "byte_start", "byte_end").mapInArrow(run, BATCH)
