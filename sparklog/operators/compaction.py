"""Compaction: which files to take, where to cut, and the rewriting itself."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import ordered_fold

CHUNK = T.StructType([T.StructField("chunk", T.IntegerType())])
TAKEN = T.StructType([T.StructField("taken", T.BooleanType())])


def select_files(files: DataFrame, *, most_files: int, most_bytes: int, order: str = "file_id") -> DataFrame:
    """Adds ``taken``: files in order while their number and bytes allow; one too large is passed over, later ones still count.

    The walk stops for good at ``most_files``. It is one sequence over the list of candidate files."""

    def step(state, row):
        n, size = state
        if n < most_files and size + row["bytes"] <= most_bytes:
            return (n + 1, size + row["bytes"]), (True,)
        return state, (False,)

    return ordered_fold(files.withColumn("__all", F.lit(0)), ["__all"], [order], lambda: (0, 0), step, TAKEN).drop("__all")


def chunk_before(batches: DataFrame, target_bytes: int, *, by: tuple[str, ...] = ("topic", "partition"), order: str = "base_offset", size: str = "bytes") -> DataFrame:
    """Adds ``chunk``: a new one begins where a batch would carry the open chunk beyond the target."""

    def step(state, row):
        chunk, held = state
        if held and held + row[size] > target_bytes:
            chunk, held = chunk + 1, 0
        return (chunk, held + row[size]), (chunk,)

    return ordered_fold(batches, list(by), [order], lambda: (0, 0), step, CHUNK)


def chunk_after(rows: DataFrame, target_bytes: int, *, by: tuple[str, ...] = ("topic", "partition"), order: str = "offset", size: str = "bytes") -> DataFrame:
    """Adds ``chunk``: a chunk ends with the row that reaches the target."""

    def step(state, row):
        chunk, held = state
        held += row[size]
        return ((chunk + 1, 0) if held >= target_bytes else (chunk, held)), (chunk,)

    return ordered_fold(rows, list(by), [order], lambda: (0, 0), step, CHUNK)


def pick_buckets(files: DataFrame, *, target_bytes: int, least_files: int, most_files: int, now_ms: int, force_age_ms: int) -> DataFrame:
    """The files of each partition to merge: the shortest prefix that reaches the target with files enough.

    Where none does, the first ``most_files`` are taken once the oldest has reached the age and there are enough.
    ``files``: topic, partition, min_offset, bytes, created_ms."""
    order = Window.partitionBy("topic", "partition").orderBy("min_offset")
    run = files.withColumn("turn", F.row_number().over(order)).withColumn("running", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    full = (F.col("running") >= target_bytes) & (F.col("turn") >= least_files) & (F.col("turn") <= most_files)
    pick = run.groupBy("topic", "partition").agg(F.min(F.when(full, F.col("turn"))).alias("by_size"), F.min(F.when(F.col("turn") <= most_files, F.col("created_ms"))).alias("oldest"), F.count("*").alias("n"))
    aged = (F.col("oldest") <= now_ms - force_age_ms) & (F.col("n") >= least_files)
    until = pick.select("topic", "partition", F.coalesce("by_size", F.when(aged, F.least(F.col("n"), F.lit(most_files)))).alias("until"), F.when(F.col("by_size").isNotNull(), "size").otherwise("age").alias("trigger"))
    return run.join(until.where("until is not null"), ["topic", "partition"]).where("turn <= until").drop("running", "until")


def merge_plan(files: DataFrame, target_bytes: int) -> DataFrame:
    """The outputs of merging each partition's files: offsets, rows, generation one above the parents', and the parents.

    An output ends with the file that reaches the target; the next begins at the following file's first offset."""
    cut = chunk_after(files, target_bytes, order="min_offset")
    return cut.groupBy("topic", "partition", "chunk").agg(
        F.min("min_offset").alias("min_offset"), F.max("max_offset").alias("max_offset"), F.sum("bytes").alias("bytes"), F.sum("row_count").alias("row_count"),
        F.min("min_timestamp").alias("min_timestamp"), F.max("max_timestamp").alias("max_timestamp"), (F.max("generation") + 1).alias("generation"), F.array_sort(F.collect_set("file_id")).alias("parents"),
    )


def lineage(chunks: DataFrame, source: str = "file_id") -> DataFrame:
    """One edge from each chunk to each source that gave it rows."""
    return chunks.select("topic", "partition", "chunk", source).distinct()


def tombstone(files: DataFrame, taken: DataFrame, now_ms: int, key: str = "file_id") -> DataFrame:
    """Sets ``compacted_at`` of the taken files where it is null; others keep theirs."""
    out = files.join(taken.select(key, F.lit(True).alias("__taken")).distinct(), key, "left")
    return out.withColumn("compacted_at", F.when(F.col("__taken") & F.col("compacted_at").isNull(), F.lit(now_ms)).otherwise(F.col("compacted_at"))).drop("__taken")


def write_segments(records: DataFrame, path: str, *, target_bytes: int = 256 << 20, row_group_bytes: int = 64 << 20, mode: str = "append") -> None:
    """Records as Parquet by topic and partition, sorted by offset within files: zstd, with statistics to prune by.

    Rows are dealt by ranges of offsets, so that a hot partition becomes several tasks and files with narrow,
    non-overlapping offsets."""
    rows = max(1, target_bytes // 128)
    dealt = records.repartitionByRange("topic", "partition", "offset").sortWithinPartitions("topic", "partition", "offset")
    dealt.write.mode(mode).partitionBy("topic", "partition").option("compression", "zstd").option("parquet.block.size", row_group_bytes).option("maxRecordsPerFile", rows).parquet(path)


def merge_segments(spark, parents: list[str], path: str, **options) -> None:
    """Parents read and written again as one sorted run; they stay until their tombstones are due."""
    write_segments(spark.read.option("basePath", parents[0].split("/topic=")[0]).parquet(*parents), path, **options)


@dataclass(frozen=True)
class CompactionPlan:
    """What a processor decided: outputs, lineage and the sources to mark."""

    outputs: DataFrame
    lineage: DataFrame
    sources: DataFrame

    def extend(self, other: CompactionPlan) -> CompactionPlan:
        return CompactionPlan(self.outputs.unionByName(other.outputs), self.lineage.unionByName(other.lineage), self.sources.unionByName(other.sources).distinct())


Processor = Callable[[DataFrame], CompactionPlan]


def wal_to_topic_segments(batches: DataFrame, target_bytes: int) -> CompactionPlan:
    """Live WAL batches (with ``file_id``) cut into segments of one topic, and what each came from."""
    cut = chunk_before(batches, target_bytes)
    outputs = cut.groupBy("topic", "partition", "chunk").agg(F.min("base_offset").alias("min_offset"), F.max("last_offset").alias("max_offset"), F.sum("bytes").alias("bytes"), F.sum("row_count").alias("row_count"))
    return CompactionPlan(outputs, lineage(cut), cut.select("file_id").distinct())


def run_cycle(files: DataFrame, batches: DataFrame, processors: list[Processor], *, now_ms: int, most_files: int = 60, most_bytes: int = 100 << 20) -> tuple[DataFrame, CompactionPlan | None]:
    """One cycle: choose live files, let each processor plan over their batches, and mark the sources."""
    chosen = select_files(files.where("compacted_at is null"), most_files=most_files, most_bytes=most_bytes).where("taken")
    own = batches.join(chosen.select("file_id"), "file_id", "left_semi")
    plan = None
    for p in processors:
        made = p(own)
        plan = made if plan is None else plan.extend(made)
    return (files if plan is None else tombstone(files, plan.sources, now_ms)), plan
