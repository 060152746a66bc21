"""Topics, groups and configurations: requests answered as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import INTERNAL_PREFIX, OFFSETS_PARTITIONS, OFFSETS_TOPIC
from .ingest import is_internal


#: What names, partition counts and pages may be.
TOPIC_NAME, NAME_LENGTH, MOST_PARTITIONS, MOST_ROWS = "^[A-Za-z0-9._-]+$", 249, 10_000, 1_000


def validate_topics(requests: DataFrame) -> DataFrame:
    """Strips ``name`` and adds ``reason``, the first rule of names and partition counts that a request breaks, or null."""
    name = F.regexp_replace("name", r"(?U)^\s+|\s+$", "")
    reason = (
        F.when(F.coalesce("name", F.lit("")) == "", "empty_name")
        .when(F.char_length("name") > NAME_LENGTH, "long_name")
        .when(F.col("name").isin(".", ".."), "dots")
        .when(~F.col("name").rlike(TOPIC_NAME), "characters")
        .when(F.coalesce(F.col("partitions") <= 0, F.lit(True)), "no_partitions")
        .when(F.col("partitions") > MOST_PARTITIONS, "too_many_partitions")
    )
    return requests.withColumn("name", name).withColumn("reason", reason)


def _page(relation: DataFrame, key: str, limit: int, offset: int) -> DataFrame:
    if not 0 < limit <= MOST_ROWS or offset < 0:
        raise ValueError(f"a page has 1 to {MOST_ROWS} rows and begins at 0 or later")
    return relation.orderBy(key).offset(offset).limit(limit)


def create_topics(requests: DataFrame, topics: DataFrame) -> DataFrame:
    """``pos, name, error_code``; of repeated names the first counts. ``requests``: pos, name, partitions, replication."""
    turn = F.row_number().over(Window.partitionBy("name").orderBy("pos"))
    known = topics.select(F.col("topic").alias("name"), F.lit(True).alias("__known"))
    code = (
        F.when(is_internal(F.col("name")), "topic_authorization_failed")
        .when(F.coalesce("name", F.lit("")) == "", "invalid_topic_exception")
        .when(F.coalesce(F.col("partitions") <= 0, F.lit(True)), "invalid_partitions")
        .when(~F.coalesce(F.col("replication").isin(-1, 1), F.lit(False)), "invalid_replication_factor")
        .when(F.col("__known") | (F.col("__turn") > 1), "topic_already_exists")
        .otherwise("none")
    )
    return requests.withColumn("__turn", turn).join(known, "name", "left").select("pos", "name", "partitions", code.alias("error_code"))


def created_partitions(results: DataFrame) -> DataFrame:
    """The empty partitions of the topics that were created."""
    made = results.where("error_code = 'none'").select(F.col("name").alias("topic"), F.explode(F.sequence(F.lit(0), F.col("partitions") - 1)).alias("partition"))
    return made.withColumn("last_offset", F.lit(-1).cast("long")).withColumn("log_start_offset", F.lit(0).cast("long"))


def delete_topics(requests: DataFrame, topics: DataFrame) -> DataFrame:
    """``pos, name, error_code``; repeated names after the first are invalid."""
    turn = F.row_number().over(Window.partitionBy("name").orderBy("pos"))
    known = topics.select(F.col("topic").alias("name"), F.lit(True).alias("__known"))
    code = (
        F.when(F.coalesce("name", F.lit("")) == "", "invalid_request")
        .when(F.col("__turn") > 1, "invalid_request")
        .when(is_internal(F.col("name")), "topic_authorization_failed")
        .when(F.col("__known").isNull(), "unknown_topic_or_partition")
        .otherwise("none")
    )
    return requests.withColumn("__turn", turn).join(known, "name", "left").select("pos", "name", code.alias("error_code"))


def drop_topics(relation: DataFrame, deleted: DataFrame) -> DataFrame:
    """Any relation with a ``topic`` column, without those deleted."""
    return relation.join(deleted.where("error_code = 'none'").select(F.col("name").alias("topic")), "topic", "left_anti")


def change_configs(requests: DataFrame) -> DataFrame:
    """Creating partitions and altering configurations are accepted without effect; internal topics are refused."""
    return requests.withColumn("error_code", F.when(is_internal(F.col("name")), "topic_authorization_failed").otherwise("none"))


def describe_configs(requests: DataFrame) -> DataFrame:
    internal = is_internal(F.col("name"))
    return requests.select("name", F.when(internal, F.lit("cleanup.policy")).alias("config"), F.when(internal, F.lit("compact")).alias("value"))


def find_coordinator(requests: DataFrame, broker: int = 0) -> DataFrame:
    """Groups have the one broker; transactions and shares have none; anything else is invalid."""
    blank = F.coalesce("key", F.lit("")) == ""
    code = F.when(blank, "invalid_request").when(F.col("key_type") == 0, "none").when(F.col("key_type").isin(1, 2), "coordinator_not_available").otherwise("invalid_request")
    out = requests.withColumn("error_code", code)
    return out.withColumn("node_id", F.when(F.col("error_code") == "none", F.lit(broker)).otherwise(F.lit(-1)))


def metadata(partitions: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Topics with their partitions in order; all of them without ``names(topic)``. Unknown names are left out."""
    own = partitions if names is None else partitions.join(names.select("topic").distinct(), "topic", "left_semi")
    return own.groupBy("topic").agg(F.array_sort(F.collect_list("partition")).alias("partitions"), F.first(F.col("topic").startswith(INTERNAL_PREFIX)).alias("is_internal"))


def list_topics(topics: DataFrame, partitions: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page by name, with each topic's number of partitions and the number of all topics."""
    page = _page(topics, "topic", limit, offset)
    n = partitions.groupBy("topic").agg(F.count("*").alias("partition_count"))
    total = topics.agg(F.count("*").alias("total"))  # one row
    return page.join(n, "topic", "left").fillna(0, ["partition_count"]).crossJoin(F.broadcast(total))


def list_groups(groups: DataFrame, members: DataFrame, limit: int, offset: int, states: tuple[str, ...] = (), types: tuple[str, ...] = ()) -> DataFrame:
    """A page by id with member counts and the number of all groups that the filters admit; empty ones admit all. All groups here are of the classic type."""
    own = groups.where(F.lower("state").isin(*(s.lower() for s in states))) if states else groups
    own = own if not types or "classic" in (t.lower() for t in types) else own.limit(0)
    page = _page(own, "group_id", limit, offset)
    n = members.groupBy("group_id").agg(F.count("*").alias("member_count"))
    total = own.agg(F.count("*").alias("total"))  # one row
    return page.join(n, "group_id", "left").fillna(0, ["member_count"]).crossJoin(F.broadcast(total))


def describe_groups(requests: DataFrame, groups: DataFrame, members: DataFrame, assignments: DataFrame, committed: DataFrame) -> DataFrame:
    """State and counts of each asked group; one that is missing is Dead, with an error."""
    n = members.groupBy("group_id").agg(F.count("*").alias("member_count"))
    own = assignments.join(groups.select("group_id", "generation"), ["group_id", "generation"]).groupBy("group_id").agg(F.count("*").alias("assignment_count"))
    o = committed.groupBy("group_id").agg(F.count("*").alias("offset_count"))
    out = requests.join(groups.select("group_id", "state", "generation"), "group_id", "left")
    for more in (n, own, o):
        out = out.join(more, "group_id", "left")
    code = F.when(F.col("state").isNull(), "group_id_not_found").otherwise("none")
    return out.select("pos", "group_id", code.alias("error_code"), F.coalesce("state", F.lit("Dead")).alias("state"), "generation", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("member_count", "assignment_count", "offset_count")))


def describe_members(requests: DataFrame, groups: DataFrame, members: DataFrame, protocols: DataFrame) -> DataFrame:
    """The members of each asked group ``(pos, group_id)`` with their metadata under its protocol, empty where they have none."""
    own = requests.join(groups.select("group_id", "protocol"), "group_id").join(members.select("group_id", "member_id"), "group_id")
    listed = protocols.select("group_id", "member_id", F.col("name").alias("protocol"), "metadata")
    return own.join(listed, ["group_id", "member_id", "protocol"], "left").select("pos", "group_id", "member_id", F.coalesce("metadata", F.lit("")).alias("metadata"))


def group_assignments(groups: DataFrame, members: DataFrame, assignments: DataFrame) -> DataFrame:
    """Assignments of the current generation with their members' ids; an assignment without member has an empty one."""
    own = assignments.join(groups.select("group_id", "generation"), ["group_id", "generation"])
    held = members.select("group_id", "member_id", F.lit(True).alias("__known"))
    return own.join(held, ["group_id", "member_id"], "left").select("group_id", "topic", "partition", F.when(F.col("__known"), F.col("member_id")).otherwise("").alias("member_id"))


def missing_internal_partitions(spark: SparkSession, partitions: DataFrame, topic: str = OFFSETS_TOPIC, n: int = OFFSETS_PARTITIONS) -> DataFrame:
    wanted = spark.range(n).select(F.lit(topic).alias("topic"), F.col("id").cast("int").alias("partition"))
    return wanted.join(partitions.select("topic", "partition"), ["topic", "partition"], "left_anti")
