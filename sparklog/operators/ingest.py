"""Ingest: validation, offset assignment and idempotence of arriving batches."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import ordered_fold

#: Arrivals that one task numbers at a time.
BLOCK_ROWS = 1_000_000
INT16_MAX = 32767
#: Batches of a producer session and partition that are kept to recognise retries, and for how long.
RECENT_BATCHES, RECENT_TTL_MS = 50, 3_600_000


def assign_offsets(arrivals: DataFrame, *, order: str, partitions: DataFrame | None = None, block_rows: int = BLOCK_ROWS, by: tuple[str, ...] = ("topic", "partition"), into: str = "offset") -> DataFrame:
    """Adds ``offset`` (or the column ``into``): each partition's next offsets in order of arrival, without gaps.

    ``order`` is a whole number that rises with arrival, ties being broken by nothing. Arrivals are numbered in
    blocks of it, which the counts of earlier blocks shift, so that a hot partition isn't one task's work.
    ``partitions(topic, partition, last_offset)`` gives where to go on; without it logs begin at 0.
    """
    by = list(by)
    dealt = arrivals.withColumn("__block", F.floor(F.col(order) / block_rows))
    counts = dealt.groupBy(*by, "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    if partitions is not None:
        starts = starts.join(partitions.select(*by, "last_offset"), by, "left").withColumn("__start", F.col("__start") + F.coalesce("last_offset", F.lit(-1)) + 1).drop("last_offset")
    within = F.row_number().over(Window.partitionBy(*by, "__block").orderBy(order)) - 1
    out = dealt.withColumn("__within", within).join(starts, [*by, "__block"])
    return out.withColumn(into, (F.col("__start") + F.col("__within")).cast("long")).drop("__block", "__within", "__start")


def assign_batch_offsets(batches: DataFrame, partitions: DataFrame, *, order: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``base_offset`` and ``last_offset`` for batches of ``row_count`` records: a running sum after the last offset.

    Summed in blocks of ``order``, as ``assign_offsets`` numbers rows."""
    by = ["topic", "partition"]
    dealt = batches.withColumn("__block", F.floor(F.col(order) / block_rows))
    sums = dealt.groupBy(*by, "__block").agg(F.sum("row_count").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    starts = starts.join(partitions.select(*by, F.col("last_offset").alias("__last")), by)
    run = Window.partitionBy(*by, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("__run", F.coalesce(F.sum("row_count").over(run), F.lit(0))).join(starts, [*by, "__block"])
    base = F.col("__last") + 1 + F.col("__start") + F.col("__run")
    return out.withColumn("base_offset", base.cast("long")).withColumn("last_offset", (F.col("base_offset") + F.col("row_count") - 1).cast("long")).drop("__block", "__run", "__start", "__last")


def is_internal(topic: Column) -> Column:
    return F.coalesce(topic.startswith("__"), F.lit(False))


def is_idempotent(producer_id: Column, epoch: Column, sequence: Column) -> Column:
    return (producer_id >= 0) & (epoch >= 0) & (sequence >= 0)


def validate(batches: DataFrame, partitions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds ``error_code``; the first rule that fails names it. Empty batches are accepted and append nothing.

    ``batches``: topic, partition, parsed, magic, row_count, producer_id, producer_epoch, base_sequence.
    """
    known = partitions.select("topic", "partition", F.lit(True).alias("__known"))
    own = sessions.select(F.col("producer_id"), F.col("producer_epoch").alias("__epoch"))
    idempotent = is_idempotent(F.col("producer_id"), F.col("producer_epoch"), F.col("base_sequence"))
    code = (
        F.when(is_internal(F.col("topic")), "topic_authorization_failed")
        .when(~F.coalesce("parsed", F.lit(False)), "invalid_record")
        .when(F.col("magic") != 2, "unsupported_for_message_format")
        .when(F.col("row_count") == 0, "none")
        .when(F.col("__known").isNull(), "unknown_topic_or_partition")
        .when(idempotent & F.col("__epoch").isNull(), "unknown_producer_id")
        .when(idempotent & (F.col("__epoch") != F.col("producer_epoch")), "invalid_producer_epoch")
        .otherwise("none")
    )
    return batches.join(known, ["topic", "partition"], "left").join(own, "producer_id", "left").withColumn("error_code", code).drop("__known", "__epoch")


IDEMPOTENCE = T.StructType([T.StructField("outcome", T.StringType()), T.StructField("first_offset", T.LongType())])


def idempotent_append(batches: DataFrame, *, order: str, keep: int = RECENT_BATCHES, at_ms: str | None = None, ttl_ms: int = RECENT_TTL_MS) -> DataFrame:
    """Adds ``outcome`` and ``first_offset``, batch after batch within a partition of a topic.

    Per producer and epoch the next sequence is expected. A batch beyond it is ``out_of_order_sequence_number``. One
    before it is a ``duplicate``, which gets the offset it had, if the same range is among the last ``keep`` that were
    appended and, where the column ``at_ms`` tells times, not older than ``ttl_ms``; else it is out of order too. Other
    batches are ``appended``; a rejected batch changes nothing. Batches need topic, partition, producer_id,
    producer_epoch, base_sequence, last_sequence and row_count; a partition starts at offset 0.
    """

    def step(state, row):
        producer = (row["producer_id"], row["producer_epoch"])
        if min(row["producer_id"], row["producer_epoch"], row["base_sequence"]) < 0:
            first = state["next"]
            state["next"] += row["row_count"]
            return state, ("appended", first)
        now = row[at_ms] if at_ms else None
        expected, recent = state["of"].setdefault(producer, [0, deque(maxlen=keep)])
        if row["base_sequence"] != expected:
            for base, last, first, at in recent if row["base_sequence"] < expected else ():
                if (base, last) == (row["base_sequence"], row["last_sequence"]) and (now is None or at is None or now - at <= ttl_ms):
                    return state, ("duplicate", first)
            return state, ("out_of_order_sequence_number", None)
        first = state["next"]
        state["next"] += row["row_count"]
        recent.append((row["base_sequence"], row["last_sequence"], first, now))
        state["of"][producer][0] = row["last_sequence"] + 1
        return state, ("appended", first)

    return ordered_fold(batches, ["topic", "partition"], [order], lambda: {"next": 0, "of": {}}, step, IDEMPOTENCE)


def recent_batches(batches: DataFrame, keep: int = RECENT_BATCHES) -> DataFrame:
    """The last ``keep`` batches of each producer session and partition, by sequence."""
    latest = Window.partitionBy("producer_id", "producer_epoch", "topic", "partition").orderBy(F.desc("base_sequence"))
    return batches.withColumn("__rank", F.row_number().over(latest)).where(F.col("__rank") <= keep).drop("__rank")


def partition_state(appended: DataFrame) -> DataFrame:
    """Each session's next sequence and last acknowledged offsets in each partition."""
    last = F.max(F.struct("base_sequence", "last_sequence", "first_offset", "row_count")).alias("x")
    out = appended.groupBy("producer_id", "producer_epoch", "topic", "partition").agg(last)
    return out.select("producer_id", "producer_epoch", "topic", "partition", (F.col("x.last_sequence") + 1).alias("next_sequence"), F.col("x.first_offset").alias("last_first_offset"), (F.col("x.first_offset") + F.col("x.row_count") - 1).alias("last_offset"))


def allocate_producer_ids(requests: DataFrame) -> DataFrame:
    """``producer_id`` and ``producer_epoch`` for each request, in order of ``request_no``.

    A transactional id keeps the producer id of its first request and counts epochs up, modulo 32768; a request
    without one (null or blank) always gets a new id at epoch 0. Ids follow the requests that open them.
    """
    name = F.nullif(F.trim("transactional_id"), F.lit(""))
    own = requests.withColumn("__owner", F.coalesce(F.concat(F.lit("t"), name), F.concat(F.lit("r"), F.col("request_no").cast("string"))))
    firsts = own.groupBy("__owner").agg(F.min("request_no").alias("__first")).withColumn("__all", F.lit(0))
    ids = assign_offsets(firsts, order="__first", by=("__all",), into="__id").select("__owner", (F.col("__id") + 1).alias("producer_id"))
    turned = assign_offsets(own, order="request_no", by=("__owner",), into="__turn")
    return turned.withColumn("producer_epoch", (F.col("__turn") % (INT16_MAX + 1)).cast("int")).join(ids, "__owner").drop("__owner", "__turn")


def live_sessions(sessions: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """Sessions that haven't passed ``expires_at_ms`` or, where that is null, ``ttl_ms`` since they were last seen."""
    dead = F.coalesce(F.col("expires_at_ms") < now_ms, F.col("last_seen_ms") < now_ms - ttl_ms, F.lit(False))
    return sessions.where(~dead)


def live_recent_batches(batches: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    return batches.where(~F.coalesce(F.col("created_at_ms") < now_ms - ttl_ms, F.lit(False)))
