"""The fixed relations of a record log."""

from __future__ import annotations

from pyspark.sql import types as T

HEADER = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", T.BinaryType())])
RECORD = T.StructType(
    [
        T.StructField("topic", T.StringType(), False),
        T.StructField("partition", T.IntegerType(), False),
        T.StructField("offset", T.LongType(), False),
        T.StructField("timestamp_ms", T.LongType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("headers", T.ArrayType(HEADER, False)),
    ]
)
BATCH = T.StructType(
    [
        T.StructField("topic", T.StringType(), False),
        T.StructField("partition", T.IntegerType(), False),
        T.StructField("base_offset", T.LongType(), False),
        T.StructField("last_offset", T.LongType(), False),
        T.StructField("attributes", T.ShortType()),
        T.StructField("base_timestamp", T.LongType()),
        T.StructField("max_timestamp", T.LongType()),
        T.StructField("producer_id", T.LongType()),
        T.StructField("producer_epoch", T.ShortType()),
        T.StructField("base_sequence", T.IntegerType()),
        T.StructField("crc", T.LongType()),
        T.StructField("byte_start", T.LongType()),
        T.StructField("byte_end", T.LongType()),
        T.StructField("records", T.ArrayType(T.StructType(RECORD.fields[2:]), False)),
    ]
)
GROUP_STATES = ("Empty", "PreparingRebalance", "CompletingRebalance", "Stable", "Dead")
INTERNAL_PREFIX = "__"
OFFSETS_TOPIC = "__consumer_offsets"
OFFSETS_PARTITIONS = 50
