"""Streams of commits and heartbeats: the current offsets, and members that time out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.offsets import latest


def current_offsets(commits: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps ``path/snapshot=N`` of the latest entry of each key, tombstones among them, after each micro-batch.

    A snapshot is made of the one before and the batch, so that a batch run again makes the same one."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number:
            rows = rows.unionByName(spark.read.parquet(f"{path}/snapshot={number - 1}"))
        latest(rows).write.mode("overwrite").parquet(f"{path}/snapshot={number}")

    return commits.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Liveness(StatefulProcessor):
    """A member's last heartbeat; a timer fires when its session has passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("ms", T.LongType()), T.StructField("timeout", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows))
        newest = came.loc[came["heartbeat_ms"].idxmax()]
        ms, timeout = int(newest["heartbeat_ms"]), max(1, int(newest["session_timeout_ms"]))
        found = self.last.get()
        if found and found[0] >= ms:
            return iter(())
        if found:
            self.handle.deleteTimer(found[0] + found[1] + 1)
        self.last.update((ms, timeout))
        self.handle.registerTimer(ms + timeout + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = self.last.get()
        self.last.clear()
        yield pd.DataFrame({"group_id": [key[0]], "member_id": [key[1]], "expired_ms": [found[0] + found[1] + 1]})

    def close(self) -> None:
        pass


def expirations(heartbeats: DataFrame, event_time: str = "at", delay: str = "0 seconds") -> DataFrame:
    """``group_id, member_id, expired_ms`` of members without a heartbeat for their session timeout, by event time."""
    keyed = heartbeats.withWatermark(event_time, delay).groupBy("group_id", "member_id")
    return keyed.transformWithStateInPandas(Liveness(), outputStructType="group_id string, member_id string, expired_ms bigint", outputMode="Append", timeMode="EventTime")


def live_members(heartbeats: DataFrame) -> DataFrame:
    """The last heartbeat of each member, for a batch view."""
    return heartbeats.groupBy("group_id", "member_id").agg(F.max("heartbeat_ms").alias("last_heartbeat_ms"), F.max_by("session_timeout_ms", "heartbeat_ms").alias("session_timeout_ms"))
