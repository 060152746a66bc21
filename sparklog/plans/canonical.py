"""Log relations over the driver's tables, in Spark and, for the checks, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import assign_offsets
from ..operators.segments import batch_index, segment_index

BATCH_RECORDS, SEGMENT_RECORDS, COMPACTED_SEGMENTS = 10, 100, 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a topic of four partitions, in order of arrival."""
    e = table(spark, sf_dir, "events")
    arrivals = e.select(
        F.lit("events").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"),
        F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"), "event_type", "event_id", "user_id",
    )
    return assign_offsets(arrivals, order="event_id")


def event_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_index(event_log(spark, sf_dir), BATCH_RECORDS)


def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of 100 offsets; the first ten of a partition are compacted, later ones live."""
    out = segment_index(event_log(spark, sf_dir), SEGMENT_RECORDS)
    return out.withColumn("tier", F.when(F.col("segment_no") < COMPACTED_SEGMENTS, "topic_wal").otherwise("wal"))


def event_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the partitions; the first offsets of the odd ones have been cut off."""
    log = event_log(spark, sf_dir).groupBy("topic", "partition").agg(F.max("offset").alias("last_offset"))
    return log.withColumn("log_start_offset", F.when(F.col("partition") % 2 == 1, 5).otherwise(0).cast("long"))


LOG = """log AS (SELECT 'events' AS topic, CAST(user_id % 4 AS INT) AS "partition", row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS "offset",
  epoch_us(ts) // 1000 AS timestamp_ms, CAST(user_id AS VARCHAR) AS key, props AS value, event_type, event_id, user_id FROM events)"""
BATCHES = f"""{LOG}, batches AS (SELECT topic, "partition", "offset" // 10 AS batch_no, min("offset") AS base_offset, max("offset") AS last_offset, CAST(sum(octet_length(encode(value)) + 61) AS BIGINT) AS bytes,
  min(timestamp_ms) AS min_timestamp, max(timestamp_ms) AS max_timestamp, count(*) AS row_count FROM log GROUP BY ALL)"""
SEGMENTS = f"""{LOG}, segments AS (SELECT topic, "partition", "offset" // 100 AS segment_no, min("offset") AS base_offset, max("offset") AS last_offset, CAST(sum(octet_length(encode(value)) + 61) AS BIGINT) AS bytes,
  min(timestamp_ms) AS min_timestamp, max(timestamp_ms) AS max_timestamp, count(*) AS row_count, max("offset") - min("offset") + 1 AS total_messages,
  CASE WHEN "offset" // 100 < 10 THEN 'topic_wal' ELSE 'wal' END AS tier FROM log GROUP BY ALL)"""
PARTITIONS = f"""{LOG}, partitions AS (SELECT topic, "partition", max("offset") AS last_offset, CAST(CASE WHEN "partition" % 2 = 1 THEN 5 ELSE 0 END AS BIGINT) AS log_start_offset FROM log GROUP BY ALL)"""
