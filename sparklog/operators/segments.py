"""The segment index: zone maps of the log, pruning by them, and the views that introspection gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _rollup(log: DataFrame, records: int, name: str) -> DataFrame:
    size = (F.length(F.col("value").cast("binary")) + 61).cast("long")
    return log.groupBy("topic", "partition", F.floor(F.col("offset") / records).alias(name)).agg(
        F.min("offset").alias("base_offset"), F.max("offset").alias("last_offset"), F.sum(size).alias("bytes"),
        F.min("timestamp_ms").alias("min_timestamp"), F.max("timestamp_ms").alias("max_timestamp"), F.count("*").alias("row_count"),
    )


def batch_index(log: DataFrame, records: int) -> DataFrame:
    """A row for each batch: offsets, timestamps, bytes. Timestamps of 0 records are null and never pruned."""
    return _rollup(log, records, "batch_no")


def segment_index(log: DataFrame, records: int) -> DataFrame:
    """A row for each partition and segment. ``total_messages`` spans offsets, holes included; ``row_count`` doesn't."""
    return _rollup(log, records, "segment_no").withColumn("total_messages", F.col("last_offset") - F.col("base_offset") + 1)


def prune_by_time(segments: DataFrame, at_ms: int) -> DataFrame:
    """Segments that may hold a record at or after a time; those without timestamps can't be ruled out."""
    return segments.where(F.col("max_timestamp").isNull() | (F.col("max_timestamp") >= at_ms))


def prune_by_offset(segments: DataFrame, low: int, high: int | None = None) -> DataFrame:
    out = segments.where(F.col("last_offset") >= low)
    return out if high is None else out.where(F.col("base_offset") <= high)


def live(segments: DataFrame) -> DataFrame:
    return segments.where(F.col("compacted_at").isNull())


def overlaps(segments: DataFrame) -> DataFrame:
    """Segments that begin before the highest end of the earlier ones of their partition and tier."""
    earlier = Window.partitionBy("topic", "partition", "tier").orderBy("base_offset", "last_offset").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("previous_last", F.max("last_offset").over(earlier)).where(F.col("base_offset") <= F.col("previous_last"))


def topic_offset_visibility(partitions: DataFrame, segments: DataFrame) -> DataFrame:
    """Each partition's bounds beside count, lowest and highest offset of its live and its compacted segments."""
    stats = segments.groupBy("topic", "partition").agg(
        *(
            f.alias(f"{tier}_{n}")
            for tier in ("wal", "topic_wal")
            for n, f in (("count", F.count_if(F.col("tier") == tier)), ("min_offset", F.min(F.when(F.col("tier") == tier, F.col("base_offset")))), ("max_offset", F.max(F.when(F.col("tier") == tier, F.col("last_offset")))))
        )
    )
    out = partitions.join(stats, ["topic", "partition"], "left")
    return out.select("topic", "partition", "log_start_offset", "last_offset", *(F.coalesce(F.col(c), F.lit(0)).alias(c) if c.endswith("_count") else F.col(c) for c in stats.columns[2:]))


def constraint_violations(segments: DataFrame, partitions: DataFrame) -> DataFrame:
    """``rule, n``: broken integrity rules of the metadata, each with its count."""
    twice = partitions.groupBy("topic", "partition").count().where("count > 1").select(F.lit("partition listed twice").alias("rule"))
    double = segments.groupBy("topic", "partition", "tier", "segment_no").count().where("count > 1").select(F.lit("segment listed twice").alias("rule"))
    over = overlaps(segments).select(F.lit("segments overlap").alias("rule"))
    orphan = segments.join(partitions, ["topic", "partition"], "left_anti").select(F.lit("segment without partition").alias("rule"))
    return twice.union(double).union(over).union(orphan).groupBy("rule").agg(F.count("*").alias("n"))
