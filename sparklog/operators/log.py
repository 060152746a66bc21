"""Reading the log: offset ranges, byte budgets, tiers, and offset lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LATEST, EARLIEST = -1, -2
INTERNAL_ROWS = 1_000


def fetch(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Records of each request ``(pos, topic, partition, start_offset)`` at or after its offset, a hole leading to the next record.

    Requests are few, so Spark broadcasts them and prunes partitions by them; order by ``pos, offset`` for replies.
    """
    return log.join(requests, ["topic", "partition"]).where(F.col("offset") >= F.col("start_offset"))


def fetch_check(requests: DataFrame, partitions: DataFrame) -> DataFrame:
    """Adds ``error_code``, watermarks and ``at_end`` to requests with ``start_offset`` and ``max_bytes``; the first failing rule counts.

    ``high_watermark`` is the last offset, ``log_end_offset`` one more.
    """
    out = requests.join(partitions, ["topic", "partition"], "left")
    start, last = F.col("start_offset"), F.col("last_offset")
    code = (
        F.when(last.isNull(), "unknown_topic_or_partition")
        .when(F.col("max_bytes") <= 0, "invalid_request")
        .when((start < F.col("log_start_offset")) | (start > last + 1), "offset_out_of_range")
        .otherwise("none")
    )
    ok = F.col("error_code") == "none"
    out = out.withColumn("error_code", code).withColumn("at_end", ok & (start == last + 1))
    return out.select("pos", "topic", "partition", "start_offset", "error_code", "at_end", last.alias("high_watermark"), last.alias("last_stable_offset"), (last + 1).alias("log_end_offset"), "log_start_offset")


def fetch_within_budget(batches: DataFrame, requests: DataFrame) -> DataFrame:
    """Batches for each request while ``max_bytes`` last; the first is returned whatever its size."""
    reach = batches.join(requests, ["topic", "partition"]).where(F.col("last_offset") >= F.col("start_offset"))
    order = Window.partitionBy("pos").orderBy("base_offset")
    run = reach.withColumn("running_bytes", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("turn", F.row_number().over(order))
    return run.where((F.col("running_bytes") <= F.col("max_bytes")) | (F.col("turn") == 1)).drop("turn")


def merge_tiers(wal: DataFrame, compacted: DataFrame) -> DataFrame:
    """Each offset once from both tiers; the live tier wins where both hold it."""
    tagged = wal.withColumn("tier", F.lit("wal")).unionByName(compacted.withColumn("tier", F.lit("topic_wal")))
    kept = [c for c in tagged.columns if c not in ("topic", "partition", "offset")]
    pick = F.min(F.struct((F.col("tier") != "wal").alias("rank"), *kept)).alias("x")
    return tagged.groupBy("topic", "partition", "offset").agg(pick).select("topic", "partition", "offset", *(F.col(f"x.{c}") for c in kept))


def list_offsets(requests: DataFrame, partitions: DataFrame, log: DataFrame | None = None, segments: DataFrame | None = None, segment_records: int = 100) -> DataFrame:
    """``pos, topic, partition, at_ms, error_code, timestamp_ms, offset`` for requests with ``at_ms``.

    -1 asks for the end, -2 for the start. A time asks for the lowest offset from the start on whose record is at
    or after it; segments whose zone map ends before it aren't read. Beyond the highest time the end is given.
    """
    known = requests.join(partitions, ["topic", "partition"], "left")
    out = known.withColumn("found", F.lit(None).cast("struct<offset:bigint,timestamp_ms:bigint>"))
    if log is not None:
        timed = known.where((F.col("at_ms") >= 0) & F.col("last_offset").isNotNull())
        source = log
        if segments is not None:
            reach = segments.join(timed.select("topic", "partition", "at_ms"), ["topic", "partition"]).where(F.col("max_timestamp").isNull() | (F.col("max_timestamp") >= F.col("at_ms")))
            source = log.withColumn("segment_no", F.floor(F.col("offset") / segment_records)).join(reach.select("topic", "partition", "segment_no").distinct(), ["topic", "partition", "segment_no"], "left_semi")
        hit = source.join(timed.select("pos", "topic", "partition", "at_ms", "log_start_offset"), ["topic", "partition"]).where((F.col("timestamp_ms") >= F.col("at_ms")) & (F.col("offset") >= F.col("log_start_offset")))
        found = hit.groupBy("pos").agg(F.min(F.struct("offset", "timestamp_ms")).alias("found"))
        out = known.join(found, "pos", "left")
    end = F.col("last_offset") + 1
    offset = F.when(F.col("at_ms") == EARLIEST, F.col("log_start_offset")).when(F.col("at_ms") == LATEST, end).otherwise(F.coalesce("found.offset", end))
    code = F.when(F.col("last_offset").isNull(), "unknown_topic_or_partition").otherwise("none")
    return out.select("pos", "topic", "partition", "at_ms", code.alias("error_code"), F.col("found.timestamp_ms").alias("timestamp_ms"), offset.alias("offset"))


def internal_bounds(changelog: DataFrame, partitions: DataFrame) -> DataFrame:
    """``partition, log_start_offset, last_offset`` of an internal topic; an empty partition has 0 and -1.

    Times asked of an internal topic give its end, so ``list_offsets`` is called without its log."""
    seen = changelog.groupBy("partition").agg(F.min("log_offset").alias("low"), F.max("log_offset").alias("high"))
    return partitions.join(seen, "partition", "left").select("partition", F.coalesce("low", F.lit(0)).alias("log_start_offset"), F.coalesce("high", F.lit(-1)).alias("last_offset"))


def fetch_internal(changelog: DataFrame, partition: int, start: int, max_bytes: int) -> DataFrame:
    """Changelog rows from an offset on, 1000 at most, within a byte budget that the first may exceed."""
    rows = changelog.where((F.col("partition") == partition) & (F.col("log_offset") >= start)).orderBy("log_offset").limit(INTERNAL_ROWS)
    size = F.length("key_bytes") + F.coalesce(F.length("value_bytes"), F.lit(0))
    order = Window.partitionBy("partition").orderBy("log_offset")
    run = rows.withColumn("running_bytes", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("turn", F.row_number().over(order))
    return run.where((F.col("running_bytes") <= max_bytes) | (F.col("turn") == 1)).drop("turn")
