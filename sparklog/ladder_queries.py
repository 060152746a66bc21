"""More of the query catalogue: commits, joins, rebalances, administration and retries. Importing it registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import keys
from .operators import catalog, groups, ingest, log, offsets
from .plans import canonical as c
from .plans.canonical import BATCHES, LOG
from .queries import COMMITS, GONE, LISTED, MEMBERS, NEW, NOW, TOPICS, _arrivals, _asked_topics, _commits, _groups, _members, _protocols, _requests, _topics, query
from .sources.shared import fresh_dir
from .streaming import ingest as ingest_stream

# --- commits and internal logs


@query(f"""WITH {MEMBERS}, calm AS (SELECT * REPLACE (CASE WHEN group_id IN ('g4', 'g9') THEN {NOW} ELSE last_heartbeat_ms END AS last_heartbeat_ms) FROM members),
asks AS (SELECT c_custkey AS pos, CASE WHEN c_custkey % 17 = 0 THEN 'g99' ELSE group_id END AS group_id, CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 19 = 0 THEN 'x' ELSE member_id END AS member_id, CASE WHEN c_custkey % 7 = 0 THEN -1 WHEN c_custkey % 5 = 0 THEN 9 ELSE c_custkey % 3 END AS generation FROM members),
g AS (SELECT groups.*, state = 'CompletingRebalance' AND sync_deadline_ms < {NOW} AS late, EXISTS (SELECT 1 FROM calm m WHERE m.group_id = groups.group_id AND {GONE}) AS lost FROM groups)
SELECT pos, a.group_id, a.member_id, a.generation, CASE WHEN g.group_id IS NULL THEN 'group_id_not_found' WHEN late THEN 'rebalance_in_progress' WHEN a.generation < 0 OR a.member_id = '' THEN 'none' WHEN m.member_id IS NULL OR {GONE} THEN 'unknown_member_id'
  WHEN a.generation <> g.generation OR m.member_generation <> g.generation THEN 'illegal_generation' WHEN state <> 'Stable' OR lost THEN 'rebalance_in_progress' ELSE 'none' END AS error_code
FROM asks a LEFT JOIN g ON g.group_id = a.group_id LEFT JOIN calm m ON m.group_id = a.group_id AND m.member_id = a.member_id""")
def offset_commit_ladder(spark, d):
    m, k = _members(spark, d), F.col("c_custkey")
    asks = m.select(
        k.alias("pos"), F.when(k % 17 == 0, "g99").otherwise(F.col("group_id")).alias("group_id"), F.when(k % 11 == 0, "").when(k % 19 == 0, "x").otherwise(F.col("member_id")).alias("member_id"),
        F.when(k % 7 == 0, -1).when(k % 5 == 0, 9).otherwise(k % 3).alias("generation"), F.lit("t").alias("topic"), F.lit(0).alias("partition"),
    )
    calm = m.withColumn("last_heartbeat_ms", F.when(F.col("group_id").isin("g4", "g9"), NOW).otherwise(F.col("last_heartbeat_ms")))
    return offsets.commit_check(asks, _groups(spark, d), calm, NOW).select("pos", "group_id", "member_id", "generation", "error_code")


ASKED_GROUPS = ["view", "nobody", "click"]


@query(f"""WITH {COMMITS}, asks(pos, group_id) AS (VALUES {", ".join(f"({i}, '{g}')" for i, g in enumerate(ASKED_GROUPS))}), known AS (SELECT DISTINCT event_type AS group_id FROM events)
SELECT pos, group_id, topic, "partition", 'none' AS error_code, committed_offset FROM asks JOIN latest USING (group_id) WHERE committed_offset IS NOT NULL
UNION ALL SELECT pos, group_id, NULL, NULL, 'group_id_not_found', -1 FROM asks WHERE group_id NOT IN (SELECT group_id FROM known)""")
def offset_fetch_all(spark, d):
    known = c.table(spark, d, "events").select(F.col("event_type").alias("group_id")).distinct()
    return offsets.fetch_all_offsets(_requests(spark, list(enumerate(ASKED_GROUPS)), "pos int, group_id string"), known, offsets.current(_commits(spark, d)))


@query(f"""WITH {LOG}, own AS (SELECT "offset" AS log_offset, octet_length(encode(key)) + CASE WHEN event_id % 9 = 0 THEN 0 ELSE octet_length(encode(value)) END AS n FROM log WHERE "partition" = 2 AND "offset" >= 30 ORDER BY "offset" LIMIT 1000),
run AS (SELECT log_offset, CAST(sum(n) OVER (ORDER BY log_offset) AS BIGINT) AS running_bytes, row_number() OVER (ORDER BY log_offset) AS k FROM own) SELECT log_offset, running_bytes FROM run WHERE running_bytes <= 20000 OR k = 1""")
def fetch_internal(spark, d):
    own = c.event_log(spark, d).select("partition", F.col("offset").alias("log_offset"), F.col("key").cast("binary").alias("key_bytes"), F.when(F.col("event_id") % 9 != 0, F.col("value").cast("binary")).alias("value_bytes"))
    return log.fetch_internal(own, 2, 30, 20_000).select("log_offset", "running_bytes")


@query("SELECT event_id, epoch_us(ts) // 1000 AS commit_ms FROM events WHERE event_id % 4 <> 0 UNION ALL SELECT event_id, -1 FROM events WHERE event_id % 4 = 0")
def commit_timestamps(spark, d):
    at = F.when(F.col("event_id") % 4 != 0, F.col("ts").cast("timestamp"))
    return c.table(spark, d, "events").select("event_id", keys.commit_timestamp_ms(at).alias("commit_ms"))


# --- joins and rebalances

CALM = ("g3", "g4", "g8", "g9", "g13", "g18")
JOINING = f"""jm AS (SELECT group_id, member_id, c_custkey AS k, CASE WHEN c_custkey % 8 = 0 OR group_id IN {CALM} THEN 'i' || c_custkey END AS instance_id, session_timeout_ms + 2000 AS session_timeout_ms, rebalance_timeout_ms, group_id NOT IN {CALM} AND {GONE.replace("session_timeout_ms", "session_timeout_ms + 2000")} AS gone,
  group_id IN {CALM} OR c_custkey % 3 = 0 AS assigned, generation + CAST(c_custkey % 2 = 0 AS INT) AS join_generation, CASE WHEN c_custkey % 9 = 4 THEN 'old' ELSE 'm' END AS meta FROM members JOIN groups USING (group_id)),
jg AS (SELECT group_id, generation, state, CASE WHEN CAST(substr(group_id, 2) AS INT) % 6 <> 0 THEN 'consumer' END AS protocol_type, protocol, (SELECT max(member_id) FROM jm WHERE jm.group_id = groups.group_id) AS leader FROM groups),
asks AS (SELECT c_custkey AS pos, c_custkey AS k, CASE WHEN c_custkey % 17 = 0 THEN 'g99' ELSE 'g' || c_nationkey END AS group_id, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 19 = 0 THEN 'x' ELSE c_name END AS member_id, CASE WHEN c_custkey % 4 = 0 OR 'g' || c_nationkey IN {CALM} THEN 'i' || c_custkey END AS instance_id,
  CASE WHEN c_custkey % 23 = 0 THEN 'connect' ELSE 'consumer' END AS protocol_type, CASE WHEN c_custkey % 6 = 0 THEN 0 WHEN c_custkey % 29 = 0 THEN 10000000 WHEN c_custkey % 10 = 1 THEN 7777 ELSE 7000 + 1000 * (c_custkey % 7) END AS session_timeout_ms,
  CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 20000 + c_custkey % 11 * 1000 END AS rebalance_timeout_ms, 3 + c_custkey % 2 AS version, c_custkey % 14 = 0 AS bare, CASE WHEN c_custkey % 9 = 2 THEN 'new' ELSE 'm' END AS meta FROM customer)"""


def _offered(meta):
    """Two protocols, in order of rank."""
    return F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(n).alias("name"), meta.cast("binary").alias("metadata")) for i, n in enumerate(("range", "sticky"))))


def _joining(spark, d):
    k, calm = F.col("c_custkey"), F.col("group_id").isin(*CALM)
    g = _groups(spark, d)
    m = _members(spark, d).join(g.select("group_id", "generation"), "group_id").select(
        "group_id", "member_id", F.when((k % 8 == 0) | calm, F.concat(F.lit("i"), k.cast("string"))).alias("instance_id"), (F.col("session_timeout_ms") + 2000).alias("session_timeout_ms"), "rebalance_timeout_ms",
        F.when(calm, NOW).otherwise(F.col("last_heartbeat_ms")).alias("last_heartbeat_ms"), (calm | (k % 3 == 0)).alias("assigned"), (F.col("generation") + (k % 2 == 0).cast("int")).alias("join_generation"),
        keys.protocol_digest(_offered(F.when(k % 9 == 4, "old").otherwise("m"))).alias("protocols_hash"),
    )
    lead = m.groupBy("group_id").agg(F.max("member_id").alias("leader_member_id"))
    g = g.join(lead, "group_id", "left").withColumn("protocol_type", F.when(F.substring("group_id", 2, 9).cast("int") % 6 != 0, "consumer"))
    home = F.concat(F.lit("g"), F.col("c_nationkey").cast("string"))
    asks = c.table(spark, d, "customer").select(
        k.alias("pos"), F.when(k % 17 == 0, "g99").otherwise(home).alias("group_id"), F.when(k % 5 == 0, "").when(k % 19 == 0, "x").otherwise(F.col("c_name")).alias("member_id"),
        F.when((k % 4 == 0) | home.isin(*CALM), F.concat(F.lit("i"), k.cast("string"))).alias("instance_id"), F.when(k % 23 == 0, "connect").otherwise("consumer").alias("protocol_type"),
        F.when(k % 6 == 0, 0).when(k % 29 == 0, 10_000_000).when(k % 10 == 1, 7777).otherwise(7000 + 1000 * (k % 7)).alias("session_timeout_ms"), F.when(k % 3 == 0, 0).otherwise(20000 + k % 11 * 1000).alias("rebalance_timeout_ms"),
        (3 + k % 2).alias("version"), F.when(k % 14 == 0, F.slice(_offered(F.lit("m")), 1, 0)).otherwise(_offered(F.when(k % 9 == 2, "new").otherwise("m"))).alias("protocols"),
    )
    return asks, g, m


@query(f"""WITH {MEMBERS}, {JOINING}, named AS (SELECT a.*, h.member_id AS holder, h.gone AS holder_gone, CASE WHEN a.instance_id IS NOT NULL AND h.member_id IS NOT NULL THEN h.member_id WHEN a.member_id <> '' THEN a.member_id WHEN a.instance_id IS NOT NULL THEN a.group_id || ':' || a.instance_id ELSE 'member-' || md5(a.group_id || ':' || pos || ':{NOW}') END AS assigned_member_id
  FROM asks a LEFT JOIN jm h ON h.group_id = a.group_id AND h.instance_id = a.instance_id),
met AS (SELECT n.*, m.k IS NULL AS is_new, m.instance_id AS own_instance, m.session_timeout_ms AS own_session, m.rebalance_timeout_ms AS own_rebalance, coalesce(m.join_generation > g.generation, false) AS joined, n.bare OR m.k IS NULL OR m.meta <> n.meta AS protocols_changed, g.protocol_type AS group_type, coalesce(g.state, 'Empty') AS before, g.leader, g.protocol,
  coalesce((SELECT bool_and(NOT gone AND assigned) FROM jm x WHERE x.group_id = n.group_id), false) AS settled, coalesce(nullif(n.session_timeout_ms, 0), m.session_timeout_ms, 45000) AS s FROM named n LEFT JOIN jg g ON g.group_id = n.group_id LEFT JOIN jm m ON m.group_id = n.group_id AND m.member_id = n.assigned_member_id),
timed AS (SELECT *, coalesce(nullif(rebalance_timeout_ms, 0), own_rebalance, greatest(s, 30000)) AS r FROM met), told AS (SELECT *, NOT is_new AND (s <> own_session OR r <> own_rebalance) AS timeouts_changed,
  CASE WHEN instance_id IS NOT NULL AND member_id = '' AND NOT holder_gone THEN 'fenced_instance_id' WHEN instance_id IS NULL AND member_id <> '' AND is_new THEN 'unknown_member_id' WHEN bare OR group_type <> protocol_type THEN 'inconsistent_group_protocol'
  WHEN s NOT BETWEEN 6000 AND 300000 OR r NOT BETWEEN s AND 300000 THEN 'invalid_session_timeout' WHEN member_id = '' AND version >= 4 THEN 'member_id_required' ELSE 'none' END AS error_code FROM timed),
skipped AS (SELECT *, coalesce(error_code = 'none' AND own_instance IS NOT NULL AND leader = assigned_member_id AND protocol IS NOT NULL AND before = 'Stable' AND NOT protocols_changed AND NOT timeouts_changed AND settled, false) AS skip_assignment FROM told)
SELECT pos, group_id, error_code, assigned_member_id, skip_assignment, is_new, protocols_changed, timeouts_changed, CASE WHEN error_code = 'none' AND NOT skip_assignment AND (before = 'CompletingRebalance' OR before IN ('Empty', 'Stable') AND (protocols_changed OR timeouts_changed OR NOT joined)) THEN 'PreparingRebalance' ELSE before END AS state FROM skipped""")
def join_ladder(spark, d):
    return groups.join_check(*_joining(spark, d), NOW)


@query("""SELECT c_name AS member_id, sha256(unhex('30' || hex(encode('range')) || '00' || hex(encode(c_mktsegment)) || 'FF31' || hex(encode('sticky')) || '00' || hex(encode(c_mktsegment)) || 'FF')) AS protocols_hash FROM customer""")
def member_protocol_digest(spark, d):
    return c.table(spark, d, "customer").select(F.col("c_name").alias("member_id"), keys.protocol_digest(_offered(F.col("c_mktsegment"))).alias("protocols_hash"))


TICK = f"""tm AS (SELECT m.*, generation, CAST(substr(m.group_id, 2) AS INT) AS n FROM members m JOIN groups USING (group_id)), tj AS (SELECT group_id, member_id, rebalance_timeout_ms, n, NOT {GONE} AS alive, generation + CASE WHEN n % 4 = 0 OR (n % 4 < 3 AND c_custkey % 2 = 0) THEN 1 ELSE 0 END > generation AS joins FROM tm),
tg AS (SELECT *, CASE WHEN CAST(substr(group_id, 2) AS INT) % 4 = 1 THEN {NOW} WHEN CAST(substr(group_id, 2) AS INT) % 4 = 3 THEN {NOW} - 1 END AS join_deadline_ms, 'nobody' AS leader_member_id FROM groups)"""


def _tick(spark, d):
    g, n = _groups(spark, d), F.substring("group_id", 2, 9).cast("int")
    m = _members(spark, d).join(g.select("group_id", "generation"), "group_id")
    joins = (n % 4 == 0) | ((n % 4 < 3) & (F.col("c_custkey") % 2 == 0))
    m = m.withColumn("join_generation", F.col("generation") + joins.cast("int")).drop("generation")
    g = g.withColumn("join_deadline_ms", F.when(n % 4 == 1, NOW).when(n % 4 == 3, NOW - 1)).withColumn("leader_member_id", F.lit("nobody"))
    return g, m


@query(f"""WITH {MEMBERS}, {LISTED.replace("WHERE NOT", "WHERE NOT (c_nationkey = 8 AND (name = 'range') = (c_custkey % 2 = 0)) AND NOT (c_nationkey = 8 AND name = 'roundrobin') AND NOT")}, {TICK}, kept AS (SELECT * FROM tj WHERE alive AND joins),
num AS (SELECT group_id, count(*) FILTER (alive) AS alive, count(*) FILTER (alive AND joins) AS joined, count(*) FILTER (NOT alive) AS gone, min(rebalance_timeout_ms) FILTER (alive AND joins) AS win, min(member_id) FILTER (alive AND joins) AS lead FROM tj GROUP BY group_id),
own AS (SELECT p.* FROM protocols p JOIN kept USING (group_id, member_id)), common AS (SELECT group_id, name FROM own JOIN num USING (group_id) GROUP BY group_id, name, joined HAVING count(*) = joined),
ranked AS (SELECT o.*, row_number() OVER (PARTITION BY group_id, member_id ORDER BY rank, name) AS k FROM own o JOIN common USING (group_id, name)), tally AS (SELECT group_id, name, count(*) FILTER (k = 1) AS votes, sum(rank) AS ranks FROM ranked GROUP BY ALL),
vote AS (SELECT group_id, name AS vote FROM tally QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY votes DESC, ranks, name) = 1),
x AS (SELECT g.*, coalesce(alive, 0) AS alive, coalesce(joined, 0) AS joined, coalesce(gone, 0) AS gone, win, lead, vote, coalesce(join_deadline_ms <= {NOW}, false) AS reached FROM tg g LEFT JOIN num USING (group_id) LEFT JOIN vote USING (group_id)),
y AS (SELECT *, CASE WHEN alive = 0 OR (reached AND joined = 0) THEN 'empty' WHEN joined < alive AND NOT reached THEN 'waiting' WHEN vote IS NULL THEN 'inconsistent_group_protocol' ELSE 'completing' END AS outcome FROM x)
SELECT group_id, outcome, generation + CAST(outcome = 'completing' AS INT) AS generation, CASE WHEN outcome = 'empty' THEN 'Empty' WHEN outcome = 'completing' THEN 'CompletingRebalance' WHEN (gone > 0 AND state IN ('Empty', 'Stable')) OR (joined > 0 AND state <> 'Empty') THEN 'PreparingRebalance' ELSE state END AS state,
  CASE outcome WHEN 'completing' THEN vote WHEN 'empty' THEN NULL ELSE protocol END AS protocol, CASE outcome WHEN 'completing' THEN lead WHEN 'empty' THEN NULL ELSE leader_member_id END AS leader_member_id, CASE WHEN outcome = 'completing' OR (outcome = 'empty' AND reached) THEN joined ELSE alive END AS members,
  CAST(CASE WHEN outcome = 'completing' THEN {NOW} + least(win, 120000) END AS BIGINT) AS sync_deadline_ms FROM y""")
def rebalance_finish(spark, d):
    g, m = _tick(spark, d)
    p, k = _protocols(spark, d), F.substring("member_id", 10, 20).cast("int")
    p = p.where(~((F.col("group_id") == "g8") & ((F.col("name") == "roundrobin") | ((F.col("name") == "range") == (k % 2 == 0)))))
    return groups.rebalance_tick(g, m, p, NOW)


# --- administration


@query(f"""WITH {MEMBERS}, {LISTED}, asks(pos, group_id) AS (VALUES (0, 'g1'), (1, 'g77'), (2, 'g4'), (3, 'g23')) SELECT pos, group_id, m.member_id, CASE WHEN p.name IS NULL THEN '' ELSE 'm-' || p.name || '-' || p.member_id END AS metadata
FROM asks JOIN groups g USING (group_id) JOIN members m USING (group_id) LEFT JOIN protocols p ON p.group_id = m.group_id AND p.member_id = m.member_id AND p.name = g.protocol""")
def describe_members(spark, d):
    asks = _requests(spark, [(0, "g1"), (1, "g77"), (2, "g4"), (3, "g23")], "pos int, group_id string")
    return catalog.describe_members(asks, _groups(spark, d), _members(spark, d), _protocols(spark, d))


@query(f"""WITH {MEMBERS}, assigned AS (SELECT 'g' || s_nationkey AS group_id, CAST(s_suppkey % 3 AS INT) AS generation, 't' || s_suppkey % 4 AS topic, CAST(s_suppkey AS INT) AS "partition", CASE WHEN s_suppkey % 2 = 0 THEN (SELECT min(member_id) FROM members m WHERE m.group_id = 'g' || s_nationkey) ELSE 'gone' END AS member_id FROM supplier)
SELECT a.group_id, topic, "partition", coalesce(m.member_id, '') AS member_id FROM assigned a JOIN groups g ON g.group_id = a.group_id AND g.generation = a.generation LEFT JOIN members m ON m.group_id = a.group_id AND m.member_id = a.member_id""")
def group_assignments(spark, d):
    m, k = _members(spark, d), F.col("s_suppkey")
    least = m.groupBy("group_id").agg(F.min("member_id").alias("least"))
    own = c.table(spark, d, "supplier").select(F.concat(F.lit("g"), F.col("s_nationkey").cast("string")).alias("group_id"), (k % 3).alias("generation"), F.concat(F.lit("t"), (k % 4).cast("string")).alias("topic"), k.cast("int").alias("partition"))
    own = own.join(least, "group_id", "left").withColumn("member_id", F.when(F.col("partition") % 2 == 0, F.col("least")).otherwise("gone")).drop("least")
    return catalog.group_assignments(_groups(spark, d), m, own)


@query("""WITH asks AS (SELECT p_partkey AS pos, CASE p_partkey % 9 WHEN 0 THEN '  ' WHEN 1 THEN ' .. ' WHEN 2 THEN repeat('n', 240 + p_partkey % 20) WHEN 3 THEN p_name WHEN 4 THEN NULL ELSE ' new.' || p_partkey || ' ' END AS name, CASE p_partkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 10001 ELSE p_size END AS partitions FROM part),
own AS (SELECT pos, trim(name) AS name, partitions FROM asks) SELECT pos, name, CASE WHEN coalesce(name, '') = '' THEN 'empty_name' WHEN length(name) > 249 THEN 'long_name' WHEN name IN ('.', '..') THEN 'dots' WHEN NOT regexp_full_match(name, '[A-Za-z0-9._-]+') THEN 'characters' WHEN partitions <= 0 THEN 'no_partitions' WHEN partitions > 10000 THEN 'too_many_partitions' END AS reason FROM own""")
def validate_topics(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 9 == 0, "  ").when(k % 9 == 1, " .. ").when(k % 9 == 2, F.repeat(F.lit("n"), (240 + k % 20).cast("int"))).when(k % 9 == 3, F.col("p_name")).when(k % 9 > 4, F.concat(F.lit(" new."), k.cast("string"), F.lit(" ")))
    asks = c.table(spark, d, "part").select(k.alias("pos"), name.alias("name"), F.when(k % 7 == 0, 0).when(k % 7 == 1, 10_001).otherwise(F.col("p_size")).alias("partitions"))
    return catalog.validate_topics(asks).select("pos", "name", "reason")


CREATED = f"""{TOPICS}, {NEW}, turned AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos) AS k FROM asks), made AS (SELECT * FROM turned WHERE NOT starts_with(name, '__') AND name <> '' AND partitions > 0 AND replication IN (-1, 1) AND name NOT IN (SELECT topic FROM topics) AND k = 1)"""


@query(f"""WITH {CREATED} SELECT name AS topic, CAST(unnest(range(0, partitions)) AS INT) AS "partition", CAST(-1 AS BIGINT) AS last_offset, CAST(0 AS BIGINT) AS log_start_offset FROM made""")
def created_topic_partitions(spark, d):
    return catalog.created_partitions(catalog.create_topics(_asked_topics(spark, d), _topics(spark, d)[0])).withColumn("partition", F.col("partition").cast("int"))


@query(f"WITH {TOPICS} SELECT * FROM tparts WHERE topic >= 'Brand#3'")
def partitions_after_delete(spark, d):
    topics, partitions = _topics(spark, d)
    name = F.when(F.col("p_brand") < "Brand#3", F.col("p_brand")).otherwise(F.concat(F.lit("no-"), "p_brand"))
    asks = c.table(spark, d, "part").select(F.col("p_partkey").alias("pos"), name.alias("name"))
    return catalog.drop_topics(partitions, catalog.delete_topics(asks, topics))


@query(f"WITH {NEW} SELECT pos, name, CASE WHEN starts_with(name, '__') THEN 'topic_authorization_failed' ELSE 'none' END AS error_code FROM asks")
def change_configs(spark, d):
    return catalog.change_configs(_asked_topics(spark, d)).select("pos", "name", "error_code")


@query(f"WITH {NEW} SELECT name, CASE WHEN starts_with(name, '__') THEN 'cleanup.policy' END AS config, CASE WHEN starts_with(name, '__') THEN 'compact' END AS value FROM asks")
def describe_configs(spark, d):
    return catalog.describe_configs(_asked_topics(spark, d))


# --- retries

SEQUENCES = """sent AS (SELECT event_id, CAST(user_id % 4 AS INT) AS "partition", user_id AS producer_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events)"""


@query(f"""WITH {SEQUENCES}, placed AS (SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY event_id) - 1 AS first_offset FROM sent), late AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 4 END AS j FROM placed WHERE event_id % 17 = 0)
SELECT event_id * 4 AS arrival, producer_id, seq AS base_sequence, 'appended' AS outcome, first_offset FROM placed
UNION ALL SELECT s.event_id * 4 + CASE j WHEN 1 THEN 1 ELSE 2 END, l.producer_id, l.seq, CASE j WHEN 1 THEN 'duplicate' ELSE 'out_of_order_sequence_number' END, CASE j WHEN 1 THEN l.first_offset END FROM late l JOIN sent s ON s.producer_id = l.producer_id AND s.seq = l.seq + j""")
def produce_retry_window(spark, d):
    """Retries that come one and four batches late, where three batches are kept."""
    e = c.event_log(spark, d).select("topic", "partition", F.col("user_id").alias("producer_id"), "event_id")
    sent = ingest.assign_offsets(e, order="event_id", by=("producer_id",), into="base_sequence")
    late = sent.where("event_id % 17 = 0").withColumn("j", F.when(F.col("event_id") % 2 == 0, 1).otherwise(4)).withColumn("at", F.col("base_sequence") + F.col("j"))
    met = late.drop("event_id").join(sent.select("producer_id", F.col("base_sequence").alias("at"), "event_id"), ["producer_id", "at"])
    cols = ["topic", "partition", "producer_id", "base_sequence"]
    came = sent.select(*cols, (F.col("event_id") * 4).alias("arrival")).unionByName(met.select(*cols, (F.col("event_id") * 4 + F.when(F.col("j") == 1, 1).otherwise(2)).alias("arrival")))
    b = came.select("*", F.lit(0).alias("producer_epoch"), F.col("base_sequence").alias("last_sequence"), F.lit(1).alias("row_count"))
    return ingest.idempotent_append(b, order="arrival", keep=3).select("arrival", "producer_id", "base_sequence", "outcome", "first_offset")


@query(f"""WITH {SEQUENCES}, gaps AS (SELECT producer_id, min(seq) AS gap FROM sent WHERE event_id % 101 = 0 GROUP BY ALL), told AS (SELECT s.* FROM sent s LEFT JOIN gaps USING (producer_id) WHERE seq < coalesce(gap, 1e18)),
placed AS (SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY event_id) - 1 AS o FROM told) SELECT producer_id, "partition", max(seq) + 1 AS next_sequence, max(o) AS last_first_offset, max(o) AS last_offset FROM placed GROUP BY ALL""")
def producer_partition_state(spark, d):
    appended = ingest.idempotent_append(_arrivals(spark, d), order="arrival").where("outcome = 'appended'")
    return ingest.partition_state(appended).select("producer_id", "partition", "next_sequence", "last_first_offset", "last_offset")


@query(f"WITH {BATCHES} SELECT topic, \"partition\", batch_no FROM batches WHERE max_timestamp >= (SELECT max(timestamp_ms) FROM log) - 86400000 * 2")
def recent_batches_live(spark, d):
    b = c.event_batches(spark, d).withColumn("created_at_ms", F.col("max_timestamp"))
    now = c.table(spark, d, "events").agg(F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()[0] or 0
    return ingest.live_recent_batches(b, now, 86_400_000 * 2).select("topic", "partition", "batch_no")


@query(f"""WITH {SEQUENCES}, gaps AS (SELECT producer_id, min(seq) AS gap FROM sent WHERE event_id % 101 = 0 GROUP BY ALL), came AS (SELECT *, 0 AS copy FROM sent WHERE event_id % 101 <> 0 UNION ALL SELECT *, 1 FROM sent WHERE event_id % 101 <> 0 AND event_id % 17 = 0)
SELECT event_id * 2 + copy AS arrival, "partition", producer_id, seq AS base_sequence, CASE WHEN seq > coalesce(gap, 1e18) THEN 'out_of_order_sequence_number' WHEN copy = 1 THEN 'duplicate' ELSE 'appended' END AS outcome FROM came LEFT JOIN gaps USING (producer_id)""")
def stream_dedup(spark, d):
    """The arrivals as a stream through the sequence gate, whose state is by producer session and partition."""
    folder = fresh_dir(spark, "arrivals")
    _arrivals(spark, d).write.parquet(folder)
    ingest_stream.use_rocksdb(spark)
    came = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    out = ingest_stream.sequence_gate(came).writeStream.format("parquet").option("path", f"{folder}-out").option("checkpointLocation", f"{folder}-checkpoint")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}-out").select("arrival", "partition", "producer_id", "base_sequence", "outcome")
