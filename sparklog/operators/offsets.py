"""Consumer offsets: an append-only changelog, its latest view, and lag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import partition_for_key
from ..functions.keys import offset_key, offset_value
from ..schema import OFFSETS_PARTITIONS
from .groups import expired, state_after_expiry, sync_late
from .ingest import assign_offsets

KEY = ["group_id", "topic", "partition"]


def latest(changelog: DataFrame, order: str = "log_offset") -> DataFrame:
    """The last entry of each group, topic and partition, tombstones among them."""
    rest = [c for c in changelog.columns if c not in (*KEY, order)]
    pick = F.max(F.struct(order, *rest)).alias("x")
    return changelog.groupBy(*KEY).agg(pick).select(*KEY, F.col(f"x.{order}").alias(order), *(F.col(f"x.{c}").alias(c) for c in rest))


def current(changelog: DataFrame, order: str = "log_offset") -> DataFrame:
    """Committed offsets: the latest entries that are no tombstones (a null ``committed_offset``)."""
    return latest(changelog, order).where(F.col("committed_offset").isNotNull())


def tombstones(changelog: DataFrame, order: str = "log_offset") -> DataFrame:
    return latest(changelog, order).where(F.col("committed_offset").isNull())


def commit_check(requests: DataFrame, groups: DataFrame, members: DataFrame, now_ms: int) -> DataFrame:
    """Adds ``error_code`` to commits ``(group_id, member_id, generation, topic, partition)``; the first failing rule names it.

    A generation that is null or negative, or an empty member, commits as an administrator, without membership. A
    group whose sync deadline has passed takes no commits; members commit only to a Stable group, which it no longer
    is once one of its members has expired."""
    admin = F.coalesce(F.col("generation") < 0, F.lit(True)) | (F.coalesce("member_id", F.lit("")) == "")
    own = groups.select("group_id", F.col("generation").alias("__current"), sync_late(now_ms).alias("__late"))
    own = own.join(state_after_expiry(groups, members, now_ms).select("group_id", F.col("state").alias("__state")), "group_id")
    alive = members.where(~expired(now_ms, F.col("last_heartbeat_ms"), F.col("session_timeout_ms"))).select("group_id", "member_id", F.struct("member_generation").alias("__member"))
    out = requests.join(own, "group_id", "left").join(alive, ["group_id", "member_id"], "left")
    code = (
        F.when(F.col("__current").isNull(), "group_id_not_found")
        .when(F.col("__late"), "rebalance_in_progress")
        .when(admin, "none")
        .when(F.col("__member").isNull(), "unknown_member_id")
        .when((F.col("generation") != F.col("__current")) | ~F.col("__member.member_generation").eqNullSafe(F.col("__current")), "illegal_generation")
        .when(F.col("__state") != "Stable", "rebalance_in_progress")
        .otherwise("none")
    )
    return out.withColumn("error_code", code).drop("__current", "__late", "__state", "__member")


def fetch_offsets(requests: DataFrame, groups: DataFrame, committed: DataFrame) -> DataFrame:
    """A row for each request ``(pos, group_id, topic, partition)``: -1 where nothing is committed, an error only for an unknown group."""
    known = requests.join(groups.select("group_id", F.lit(True).alias("__known")), "group_id", "left")
    out = known.join(committed.select(*KEY, "committed_offset"), KEY, "left")
    code = F.when(F.col("__known").isNull(), "group_id_not_found").otherwise("none")
    return out.select("pos", *KEY, code.alias("error_code"), F.coalesce(F.when(F.col("__known"), F.col("committed_offset")), F.lit(-1)).cast("long").alias("committed_offset"))


def fetch_all_offsets(requests: DataFrame, groups: DataFrame, committed: DataFrame) -> DataFrame:
    """All committed offsets of each asked group ``(pos, group_id)``; an unknown group has one row, with its error. Order by pos, topic, partition for replies."""
    known = requests.join(groups.select("group_id", F.lit(True).alias("__known")), "group_id", "left")
    out = known.join(committed.select(*KEY, "committed_offset"), "group_id", "left").where("__known is null or topic is not null")
    code = F.when(F.col("__known").isNull(), "group_id_not_found").otherwise("none")
    mine = [F.when(F.col("__known"), F.col(c)).alias(c) for c in ("topic", "partition")]
    return out.select("pos", "group_id", *mine, code.alias("error_code"), F.when(F.col("__known"), F.col("committed_offset")).otherwise(-1).cast("long").alias("committed_offset")).distinct()


def encode_changelog(entries: DataFrame, partitions: int = OFFSETS_PARTITIONS) -> DataFrame:
    """``key_bytes``, ``value_bytes`` (null for a tombstone), the internal partition of the key and its next offsets by ``seq``."""
    key = offset_key(F.col("group_id"), F.col("topic"), F.col("partition"))
    value = F.when(F.col("committed_offset").isNotNull(), offset_value(F.col("committed_offset"), F.col("metadata"), F.coalesce("commit_ms", F.lit(-1))))
    out = entries.withColumn("key_bytes", key).withColumn("value_bytes", value).withColumn("topic_partition", partition_for_key(F.col("key_bytes"), partitions))
    return assign_offsets(out, order="seq", by=("topic_partition",), into="log_offset")


def lag(committed: DataFrame, partitions: DataFrame, groups: DataFrame) -> DataFrame:
    """Log end less committed offset for each group and partition of the topics it reads; null without a commit."""
    topics = committed.select("group_id", "topic").distinct()
    wanted = topics.join(groups.select("group_id"), "group_id", "left_semi").join(partitions, "topic")
    out = wanted.join(committed.select(*KEY, "committed_offset"), KEY, "left")
    end = F.col("last_offset") + 1
    return out.select(*KEY, end.alias("log_end_offset"), "committed_offset", F.when(F.col("committed_offset") >= 0, end - F.col("committed_offset")).alias("lag"))
