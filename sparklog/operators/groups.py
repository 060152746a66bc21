"""Consumer groups: votes, leaders, expiry and the checks of each request, as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import capped_deadline, dynamic_member_id, protocol_digest, static_member_id

DEFAULT_REBALANCE_MS = 30_000
DEADLINE_CAP_MS = 120_000


def expired(now_ms: Column | int, last_ms: Column, timeout_ms: Column) -> Column:
    """Longer since the last heartbeat than the timeout (1 ms at least); no heartbeat at all counts as expired."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return F.coalesce(now - last_ms > F.greatest(F.lit(1), timeout_ms), F.lit(True))


def protocol_vote(protocols: DataFrame) -> DataFrame:
    """``group_id, protocol, votes, rank_sum`` of each group's elected protocol.

    Candidates are the protocols that all members list. Each member votes for its first candidate; most votes win,
    then the smaller sum of ranks, then the name. A group without a common protocol has no row.
    ``protocols``: group_id, member_id, name, rank."""
    members = protocols.groupBy("group_id").agg(F.countDistinct("member_id").alias("n"))
    common = protocols.groupBy("group_id", "name").agg(F.countDistinct("member_id").alias("k")).join(members, "group_id").where("k = n").select("group_id", "name")
    listed = protocols.join(common, ["group_id", "name"])
    first = F.row_number().over(Window.partitionBy("group_id", "member_id").orderBy("rank", "name")) == 1
    tally = listed.withColumn("vote", first).groupBy("group_id", "name").agg(F.count_if("vote").alias("votes"), F.sum("rank").alias("rank_sum"))
    best = F.min(F.struct((-F.col("votes")).alias("v"), "rank_sum", "name")).alias("x")
    return tally.groupBy("group_id").agg(best).select("group_id", F.col("x.name").alias("protocol"), (-F.col("x.v")).alias("votes"), F.col("x.rank_sum").cast("long").alias("rank_sum"))


def elect_leaders(groups: DataFrame, members: DataFrame) -> DataFrame:
    """The earlier leader if still a member, else the least member id; null for a group without members."""
    still = members.select("group_id", F.col("member_id").alias("leader_member_id"), F.lit(True).alias("__still"))
    least = members.groupBy("group_id").agg(F.min("member_id").alias("__least"))
    out = groups.join(still, ["group_id", "leader_member_id"], "left").join(least, "group_id", "left")
    return out.select("group_id", F.when(F.col("__still"), F.col("leader_member_id")).otherwise(F.col("__least")).alias("leader_member_id"))


def rebalance_timeouts(groups: DataFrame, members: DataFrame, now_ms: int) -> DataFrame:
    """The least timeout of a group's unexpired members, or the default; and the deadline it gives, capped."""
    alive = members.where(~expired(now_ms, F.col("last_heartbeat_ms"), F.col("session_timeout_ms")))
    least = alive.groupBy("group_id").agg(F.min("rebalance_timeout_ms").alias("t"))
    out = groups.join(least, "group_id", "left").select("group_id", F.coalesce("t", F.lit(DEFAULT_REBALANCE_MS)).cast("long").alias("rebalance_timeout_ms"))
    return out.withColumn("deadline_ms", F.lit(now_ms) + F.least(F.col("rebalance_timeout_ms"), F.lit(DEADLINE_CAP_MS)))


def expired_members(members: DataFrame, now_ms: int) -> DataFrame:
    return members.where(expired(now_ms, F.col("last_heartbeat_ms"), F.col("session_timeout_ms")))


def state_after_expiry(groups: DataFrame, members: DataFrame, now_ms: int) -> DataFrame:
    """Group states once expired members have gone: none left is Empty (the generation stays); else an active group prepares a rebalance."""
    gone = expired(now_ms, F.col("last_heartbeat_ms"), F.col("session_timeout_ms"))
    n = members.groupBy("group_id").agg(F.count_if(gone).alias("expired"), F.count_if(~gone).alias("left"))
    out = groups.join(n, "group_id", "left").fillna(0, ["expired", "left"])
    state = F.when(F.col("expired") == 0, F.col("state")).when(F.col("left") == 0, "Empty").when(F.col("state").isin("Stable", "CompletingRebalance", "Empty"), "PreparingRebalance").otherwise(F.col("state"))
    return out.select("group_id", "generation", state.alias("state"), "expired", F.col("left").alias("members"))


def sync_late(now_ms: int) -> Column:
    return (F.col("state") == "CompletingRebalance") & F.coalesce(F.col("sync_deadline_ms") < now_ms, F.lit(False))


def sync_timeout(groups: DataFrame, now_ms: int) -> DataFrame:
    """A group completing a rebalance beyond its deadline prepares another."""
    return groups.withColumn("state", F.when(sync_late(now_ms), "PreparingRebalance").otherwise(F.col("state")))


def complete_groups(groups: DataFrame, members: DataFrame) -> DataFrame:
    """A completing group of which all members are in sync becomes Stable."""
    all_in = members.groupBy("group_id").agg(F.bool_and("is_in_sync").alias("__all"))
    ready = (F.col("state") == "CompletingRebalance") & F.coalesce("__all", F.lit(False))
    return groups.join(all_in, "group_id", "left").withColumn("state", F.when(ready, "Stable").otherwise(F.col("state"))).drop("__all")


def rebalance_tick(groups: DataFrame, members: DataFrame, protocols: DataFrame, now_ms: int) -> DataFrame:
    """Each group after one step of its rebalance: ``group_id, outcome, generation, state, protocol, leader_member_id, members, sync_deadline_ms``.

    Expired members are gone. Once all others have joined the next generation, or the join deadline has come, those
    who joined form it: the protocol is voted, the leader elected, and the group is ``completing``. Without a common
    protocol the outcome is ``inconsistent_group_protocol``; without members the group is ``empty``; else it is
    ``waiting``, and prepares a rebalance if somebody has joined or gone.
    ``groups``: group_id, generation, state, protocol, leader_member_id, join_deadline_ms; ``members`` with
    join_generation; ``protocols``: group_id, member_id, name, rank."""
    gone = expired(now_ms, F.col("last_heartbeat_ms"), F.col("session_timeout_ms"))
    own = members.join(groups.select("group_id", (F.col("generation") + 1).alias("__target")), "group_id").withColumn("__alive", ~gone)
    own = own.withColumn("__joined", F.col("__alive") & F.coalesce(F.col("join_generation") >= F.col("__target"), F.lit(False)))
    n = own.groupBy("group_id").agg(F.count_if("__alive").alias("__alive"), F.count_if("__joined").alias("__joined"), F.count_if(~F.col("__alive")).alias("__gone"))
    kept = own.where("__joined").select("group_id", "member_id", "rebalance_timeout_ms")
    vote = protocol_vote(protocols.join(kept.select("group_id", "member_id"), ["group_id", "member_id"], "left_semi")).select("group_id", F.col("protocol").alias("__vote"))
    lead = elect_leaders(groups.select("group_id", "leader_member_id"), kept).withColumnRenamed("leader_member_id", "__lead")
    window = kept.groupBy("group_id").agg(F.min("rebalance_timeout_ms").alias("__window"))
    out = groups.join(n, "group_id", "left").fillna(0, ["__alive", "__joined", "__gone"])
    for more in (vote, lead, window):
        out = out.join(more, "group_id", "left")
    reached = F.coalesce(F.col("join_deadline_ms") <= now_ms, F.lit(False))
    due = (F.col("__joined") == F.col("__alive")) | reached
    outcome = F.when((F.col("__alive") == 0) | (reached & (F.col("__joined") == 0)), "empty").when(~due, "waiting").when(F.col("__vote").isNull(), "inconsistent_group_protocol").otherwise("completing")
    out = out.withColumn("outcome", outcome)
    made, empty = F.col("outcome") == "completing", F.col("outcome") == "empty"
    disturbed = ((F.col("__gone") > 0) & F.col("state").isin("Empty", "Stable")) | ((F.col("__joined") > 0) & (F.col("state") != "Empty"))
    state = F.when(empty, "Empty").when(made, "CompletingRebalance").when(disturbed, "PreparingRebalance").otherwise(F.col("state"))
    return out.select(
        "group_id", "outcome", F.when(made, F.col("generation") + 1).otherwise(F.col("generation")).alias("generation"), state.alias("state"), F.when(made, F.col("__vote")).when(~empty, F.col("protocol")).alias("protocol"),
        F.when(made, F.col("__lead")).when(~empty, F.col("leader_member_id")).alias("leader_member_id"), F.when(made | (empty & reached), F.col("__joined")).otherwise(F.col("__alive")).alias("members"),
        F.when(made, capped_deadline(F.lit(now_ms), F.coalesce("__window", F.lit(DEFAULT_REBALANCE_MS)), DEADLINE_CAP_MS)).cast("long").alias("sync_deadline_ms"),
    )


#: The bounds of a session's timeout, the longest rebalance, and a session's timeout where none is given.
SESSION_MS, MOST_REBALANCE_MS, DEFAULT_SESSION_MS = (6_000, 300_000), 300_000, 45_000


def join_check(requests: DataFrame, groups: DataFrame, members: DataFrame, now_ms: int) -> DataFrame:
    """What each join finds: ``pos, group_id, error_code, assigned_member_id, skip_assignment, is_new, protocols_changed, timeouts_changed, state``.

    Every request is held against the relations as they stand, as if it came first. The first failing rule names the
    error. A static instance keeps the id it has, and one that lives on fences a request without id; an unknown
    dynamic id is an error; a group has one protocol type; timeouts of 0 stand for those known; from version 4 on a
    request without id gets one and must come again. The static leader of a Stable group, which comes again unchanged
    while all members live and are assigned, skips the rebalance. ``state`` is the group's after the join: members
    that are new, changed, or hadn't joined the next generation open a rebalance, and so does any join while one completes.

    ``requests``: pos, group_id, member_id, instance_id, protocol_type, session_timeout_ms, rebalance_timeout_ms,
    version, protocols (array of rank, name, metadata). ``groups``: group_id, generation, state, protocol_type,
    protocol, leader_member_id. ``members``: group_id, member_id, instance_id, both timeouts, last_heartbeat_ms,
    join_generation, assigned, protocols_hash."""
    known = members.withColumn("gone", expired(now_ms, F.col("last_heartbeat_ms"), F.col("session_timeout_ms")))
    static = known.where("instance_id <> ''").select("group_id", "instance_id", F.struct("member_id", "gone").alias("__holder"))
    all_of = known.groupBy("group_id").agg(F.bool_and(~F.col("gone") & F.col("assigned")).alias("__settled"))
    own = groups.select("group_id", F.struct("generation", "state", "protocol_type", "protocol", "leader_member_id").alias("__group")).join(all_of, "group_id", "left")
    blank, is_static = F.coalesce("member_id", F.lit("")) == "", F.coalesce("instance_id", F.lit("")) != ""
    out = requests.join(own, "group_id", "left").join(static, ["group_id", "instance_id"], "left")
    fresh = F.when(is_static, static_member_id(F.col("group_id"), F.col("instance_id"))).otherwise(dynamic_member_id(F.col("group_id"), F.col("pos"), now_ms))
    out = out.withColumn("assigned_member_id", F.when(is_static & F.col("__holder").isNotNull(), F.col("__holder.member_id")).when(~blank, F.col("member_id")).otherwise(fresh))
    mine = ("instance_id", "session_timeout_ms", "rebalance_timeout_ms", "join_generation", "protocols_hash")
    out = out.join(known.select("group_id", F.col("member_id").alias("assigned_member_id"), F.struct(*mine).alias("__member")), ["group_id", "assigned_member_id"], "left")
    session = F.coalesce(F.nullif("session_timeout_ms", F.lit(0)), "__member.session_timeout_ms", F.lit(DEFAULT_SESSION_MS))
    rebalance = F.coalesce(F.nullif("rebalance_timeout_ms", F.lit(0)), "__member.rebalance_timeout_ms", F.greatest(session, F.lit(DEFAULT_REBALANCE_MS)))
    code = (
        F.when(F.coalesce("group_id", F.lit("")) == "", "invalid_group_id")
        .when(is_static & blank & ~F.col("__holder.gone"), "fenced_instance_id")
        .when(~is_static & ~blank & F.col("__member").isNull(), "unknown_member_id")
        .when(F.coalesce(F.size("protocols"), F.lit(0)) <= 0, "inconsistent_group_protocol")
        .when(F.col("__group.protocol_type").isNotNull() & ~F.col("__group.protocol_type").eqNullSafe(F.col("protocol_type")), "inconsistent_group_protocol")
        .when(~(session.between(*SESSION_MS) & rebalance.between(session, F.lit(MOST_REBALANCE_MS))), "invalid_session_timeout")
        .when(blank & (F.col("version") >= 4), "member_id_required")
        .otherwise("none")
    )
    ok, new = F.col("error_code") == "none", F.col("__member").isNull()
    out = out.withColumn("error_code", code).withColumn("is_new", new)
    out = out.withColumn("protocols_changed", new | ~F.col("__member.protocols_hash").eqNullSafe(protocol_digest(F.col("protocols"))))
    out = out.withColumn("timeouts_changed", ~new & ((session != F.col("__member.session_timeout_ms")) | (rebalance != F.col("__member.rebalance_timeout_ms"))))
    changed = F.col("protocols_changed") | F.col("timeouts_changed")
    leads = (F.coalesce("__member.instance_id", F.lit("")) != "") & F.col("__group.leader_member_id").eqNullSafe(F.col("assigned_member_id")) & F.col("__group.protocol").isNotNull()
    skip = ok & F.coalesce(leads & (F.col("__group.state") == "Stable") & ~changed & F.col("__settled"), F.lit(False))
    out = out.withColumn("skip_assignment", skip)
    before, joined = F.coalesce("__group.state", F.lit("Empty")), F.coalesce(F.col("__member.join_generation") > F.col("__group.generation"), F.lit(False))
    opens = ok & ~F.col("skip_assignment") & ((before == "CompletingRebalance") | (before.isin("Empty", "Stable") & (changed | ~joined)))
    return out.select("pos", "group_id", "error_code", "assigned_member_id", "skip_assignment", "is_new", "protocols_changed", "timeouts_changed", F.when(opens, "PreparingRebalance").otherwise(before).alias("state"))


def heartbeat_check(requests: DataFrame, groups: DataFrame, members: DataFrame, now_ms: int) -> DataFrame:
    """The first failing rule of each heartbeat ``(pos, group_id, member_id, generation)``."""
    g = groups.select("group_id", F.col("generation").alias("__generation"), F.col("state").alias("__state"))
    m = members.select("group_id", "member_id", F.col("member_generation").alias("__member_generation"), F.lit(True).alias("__member"), expired(now_ms, F.col("last_heartbeat_ms"), F.col("session_timeout_ms")).alias("__expired"))
    out = requests.join(g, "group_id", "left").join(m, ["group_id", "member_id"], "left")
    code = (
        F.when(F.col("__state").isNull(), "group_id_not_found")
        .when(F.col("__member").isNull() | F.col("__expired"), "unknown_member_id")
        .when(F.col("generation") != F.col("__generation"), "illegal_generation")
        .when(F.col("__member_generation") != F.col("__generation"), "illegal_generation")
        .when(F.col("__state").isin("PreparingRebalance", "CompletingRebalance"), "rebalance_in_progress")
        .when(F.col("__state") != "Stable", "unknown_member_id")
        .otherwise("none")
    )
    return out.select("pos", "group_id", "member_id", "generation", code.alias("error_code"))


def sync_check(requests: DataFrame, groups: DataFrame, members: DataFrame, now_ms: int) -> DataFrame:
    """The first failing rule of each sync ``(pos, group_id, member_id, generation, protocol)``; a leader's assignments are checked by ``assignment_mismatch``."""
    g = groups.select("group_id", F.col("generation").alias("__generation"), F.col("state").alias("__state"), F.col("protocol").alias("__protocol"))
    m = members.select("group_id", "member_id", F.col("member_generation").alias("__member_generation"), F.lit(True).alias("__member"), expired(now_ms, F.col("last_heartbeat_ms"), F.col("session_timeout_ms")).alias("__expired"))
    out = requests.join(g, "group_id", "left").join(m, ["group_id", "member_id"], "left")
    code = (
        F.when(F.col("__state").isNull(), "group_id_not_found")
        .when(F.col("generation") != F.col("__generation"), "illegal_generation")
        .when(F.col("__member").isNull() | F.col("__expired"), "unknown_member_id")
        .when(F.col("__member_generation") != F.col("__generation"), "illegal_generation")
        .when(F.col("__state") == "PreparingRebalance", "rebalance_in_progress")
        .when(~F.col("__state").isin("CompletingRebalance", "Stable"), "unknown_member_id")
        .when(F.col("protocol") != F.col("__protocol"), "inconsistent_group_protocol")
        .otherwise("none")
    )
    return out.select("pos", "group_id", "member_id", "generation", code.alias("error_code"))


def leave(requests: DataFrame, groups: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results by member of ``(pos, group_id, member_id)``, and the groups after: the last one leaving opens a generation and leaves it Empty."""
    known = members.select("group_id", "member_id", F.lit(True).alias("__member"))
    out = requests.join(groups.select("group_id", F.lit(True).alias("__group")), "group_id", "left").join(known, ["group_id", "member_id"], "left")
    code = F.when(F.col("__group").isNull(), "group_id_not_found").when(F.col("__member").isNull(), "unknown_member_id").otherwise("none")
    results = out.select("pos", "group_id", "member_id", code.alias("error_code"))
    gone = results.where("error_code = 'none'").select("group_id", "member_id").distinct()
    left = members.join(gone, ["group_id", "member_id"], "left_anti").groupBy("group_id").agg(F.count("*").alias("members"))
    after = groups.join(gone.select("group_id").distinct().withColumn("__left", F.lit(True)), "group_id", "left").join(left, "group_id", "left")
    none = F.coalesce("members", F.lit(0)) == 0
    state = F.when(F.col("__left").isNull(), F.col("state")).when(none, "Empty").otherwise("PreparingRebalance")
    return results, after.select("group_id", F.when(F.col("__left") & none, F.col("generation") + 1).otherwise(F.col("generation")).alias("generation"), state.alias("state"), F.coalesce("members", F.lit(0)).alias("members"))


def assignment_mismatch(assigned: DataFrame, members: DataFrame) -> DataFrame:
    """``group_id, missing, unknown, repeated`` of groups whose leader's assignment isn't exactly one entry for each member."""
    a = assigned.groupBy("group_id", "member_id").agg(F.count("*").alias("n"))
    both = members.select("group_id", "member_id", F.lit(1).alias("m")).join(a, ["group_id", "member_id"], "full_outer")
    out = both.groupBy("group_id").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("m").isNull()).alias("unknown"), F.count_if(F.col("n") > 1).alias("repeated"))
    return out.where("missing + unknown + repeated > 0")


def leader_metadata(groups: DataFrame, members: DataFrame, protocols: DataFrame) -> DataFrame:
    """What the leader is told: each member's metadata under the elected protocol."""
    own = members.join(groups.select("group_id", "protocol"), "group_id")
    return own.join(protocols.select("group_id", "member_id", F.col("name").alias("protocol"), "metadata"), ["group_id", "member_id", "protocol"]).select("group_id", "member_id", "protocol", "metadata")
