"""Streaming ingest: micro-batches become segments and index rows; retries are dropped by keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.ingest import RECENT_BATCHES, assign_offsets
from ..operators.segments import segment_index

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """Keyed state beyond memory; ``transformWithState`` needs it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def ingest(arrivals: DataFrame, path: str, checkpoint: str, *, order: str, segment_records: int = 100_000, available_now: bool = True, interval: str = "2 seconds") -> StreamingQuery:
    """Appends each micro-batch of ``topic, partition, ...`` to ``path/records`` and its zone maps to ``path/index``.

    Offsets go on from the index as it stood before the batch, so that a batch that is run again writes the same
    offsets over the files that carry its number: the checkpoint is the acknowledgement."""

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/index")
        last = None
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            before = spark.read.parquet(f"{path}/index").where(F.col("batch_id") < number)
            last = before.groupBy("topic", "partition").agg(F.max("last_offset").alias("last_offset"))
        rows = assign_offsets(batch, order=order, partitions=last)
        out = rows.sortWithinPartitions("topic", "partition", "offset").write.mode("overwrite").option("compression", "zstd")
        out.parquet(f"{path}/records/batch_id={number}")
        written = spark.read.parquet(f"{path}/records/batch_id={number}")
        segment_index(written, segment_records).write.mode("overwrite").parquet(f"{path}/index/batch_id={number}")

    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return arrivals.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**trigger).start()


class SequenceGate(StatefulProcessor):
    """Batches of one producer session and partition in order of arrival: appended, duplicate or out of order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.expected = handle.getValueState("expected", T.StructType([T.StructField("next", T.LongType())]))
        self.recent = handle.getListState("recent", T.StructType([T.StructField("base", T.LongType()), T.StructField("last", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.expected.get()
        expected, recent = (found[0] if found else 0), [tuple(r) for r in self.recent.get()]
        came = pd.concat(list(rows)).sort_values("arrival")
        outcome = []
        for base, last in zip(came["base_sequence"], came["last_sequence"], strict=True):
            if base == expected:
                outcome.append("appended")
                expected, recent = last + 1, [*recent, (base, last)][-RECENT_BATCHES:]
            else:
                outcome.append("duplicate" if base < expected and (base, last) in recent else "out_of_order_sequence_number")
        self.expected.update((int(expected),))
        if recent:  # Spark refuses an empty list, and nothing appended leaves nothing to keep
            self.recent.put([(int(a), int(b)) for a, b in recent])
        yield came.assign(outcome=outcome)

    def close(self) -> None:
        pass


def sequence_gate(batches: DataFrame) -> DataFrame:
    """Adds ``outcome`` to a stream of ``producer_id, producer_epoch, topic, partition, base_sequence, last_sequence, arrival``.

    The last 50 ranges of a session are kept to recognise retries, as state in RocksDB."""
    schema = T.StructType([*batches.schema.fields, T.StructField("outcome", T.StringType())])
    keyed = batches.groupBy("producer_id", "producer_epoch", "topic", "partition")
    return keyed.transformWithStateInPandas(SequenceGate(), outputStructType=schema, outputMode="Append", timeMode="None")


def drop_retries(batches: DataFrame, event_time: str, delay: str = "1 hour") -> DataFrame:
    """Exact retries within a time to live, by Spark's own deduplication."""
    return batches.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["producer_id", "producer_epoch", "topic", "partition", "base_sequence"])
