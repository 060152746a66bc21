"""The query catalogue: each operator over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys
from .functions.hashes import partition_for_key
from .operators import catalog, compaction, groups, ingest, log, offsets, segments
from .plans import canonical as c
from .plans.canonical import BATCHES, LOG, PARTITIONS, SEGMENTS
from .sources import wal1
from .sources.shared import fresh_dir
from .streaming import groups as group_stream
from .streaming import ingest as ingest_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = 1_000_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def murmur_sql(source: str, partitions: int) -> str:
    """CTEs ``hashed`` that add ``slot``, the partition of a key, to the rows of ``source``, whose column ``hx`` holds the key in hexadecimal digits."""
    le = lambda at, n: "CAST('0x' || " + " || ".join(f"substr(hx, CAST({at} + {2 * i + 1} AS BIGINT), 2)" for i in reversed(range(n))) + " AS UBIGINT)"
    m, low = "CAST(1540483477 AS UBIGINT)", "CAST(4294967295 AS UBIGINT)"
    times = lambda x: f"(({x} * {m}) & {low})"
    tail = f"CASE (length(hx) // 2) % 4 WHEN 1 THEN {le('length(hx) - 2', 1)} WHEN 2 THEN {le('length(hx) - 4', 2)} WHEN 3 THEN {le('length(hx) - 6', 3)} END"
    return f"""words AS (SELECT *, list_transform(range(0, length(hx) // 8), lambda i: {le("8 * i", 4)}) AS ks, {tail} AS tail FROM {source}),
mixed AS (SELECT *, list_transform(list_transform(ks, lambda k: {times("k")}), lambda k: {times("xor(k, k >> 24)")}) AS ms FROM words),
folded AS (SELECT *, list_reduce(list_prepend(xor(CAST(2538058380 AS UBIGINT), CAST(length(hx) // 2 AS UBIGINT)), ms), lambda h, k: xor({times("h")}, k)) AS h0 FROM mixed),
tailed AS (SELECT *, CASE WHEN tail IS NULL THEN h0 ELSE {times("xor(h0, tail)")} END AS h1 FROM folded), shaken AS (SELECT *, {times("xor(h1, h1 >> 13)")} AS h2 FROM tailed),
hashed AS (SELECT *, CAST((xor(h2, h2 >> 15) & CAST(2147483647 AS UBIGINT)) % {partitions} AS INT) AS slot FROM shaken)"""


# --- reading the log


@query(f'WITH {LOG} SELECT topic, "partition", "offset", timestamp_ms, key, value, event_type AS header_value FROM log')
def log_records(spark, d):
    return c.event_log(spark, d).select("topic", "partition", "offset", "timestamp_ms", "key", "value", F.col("event_type").alias("header_value"))


FETCHES = [(0, "events", 2, 40), (1, "events", 0, 100), (2, "events", 3, 0), (3, "events", 9, 0), (4, "events", 1, 10_000_000)]
FETCH_VALUES = "requests(pos, topic, \"partition\", start_offset) AS (VALUES " + ", ".join(f"({p}, '{t}', {n}, {s})" for p, t, n, s in FETCHES) + ")"


def _requests(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _fetches(spark):
    return _requests(spark, FETCHES, "pos int, topic string, partition int, start_offset bigint")


@query(f'WITH {LOG} SELECT "offset", timestamp_ms, value FROM log WHERE "partition" = 1 AND "offset" >= 57 AND "offset" < 157')
def fetch_range(spark, d):
    own = c.event_log(spark, d)
    return log.fetch(own, _requests(spark, [(0, "events", 1, 57)], "pos int, topic string, partition int, start_offset bigint")).where("offset < 157").select("offset", "timestamp_ms", "value")


@query(f'WITH {LOG}, {FETCH_VALUES} SELECT r.pos, l.topic, l."partition", l."offset", l.timestamp_ms FROM log l JOIN requests r USING (topic, "partition") WHERE l."offset" >= r.start_offset')
def fetch_multi_request(spark, d):
    return log.fetch(c.event_log(spark, d), _fetches(spark)).select("pos", "topic", "partition", "offset", "timestamp_ms")


CHECKS = [(0, "events", 0, 0, 100), (1, "events", 1, 0, 100), (2, "events", 1, 5, 0), (3, "events", 9, 0, 100), (4, "events", 2, 99_999_999, 100), (5, "nope", 0, 0, 0), (6, "events", 3, 6, 1)]
CHECK_VALUES = "requests(pos, topic, \"partition\", start_offset, max_bytes) AS (VALUES " + ", ".join(f"({p}, '{t}', {n}, {s}, {b})" for p, t, n, s, b in CHECKS) + ")"


@query(f"""WITH {PARTITIONS}, {CHECK_VALUES}, coded AS (SELECT r.*, p.last_offset, p.log_start_offset, CASE WHEN p.last_offset IS NULL THEN 'unknown_topic_or_partition' WHEN max_bytes <= 0 THEN 'invalid_request'
  WHEN start_offset < log_start_offset OR start_offset > last_offset + 1 THEN 'offset_out_of_range' ELSE 'none' END AS error_code FROM requests r LEFT JOIN partitions p USING (topic, "partition"))
SELECT pos, topic, "partition", start_offset, error_code, error_code = 'none' AND start_offset = last_offset + 1 AS at_end, last_offset AS high_watermark, last_offset AS last_stable_offset, last_offset + 1 AS log_end_offset, log_start_offset FROM coded""")
def fetch_error_ladder(spark, d):
    return log.fetch_check(_requests(spark, CHECKS, "pos int, topic string, partition int, start_offset bigint, max_bytes bigint"), c.event_partitions(spark, d)).withColumn("at_end", F.when(F.col("high_watermark").isNull() & (F.col("error_code") == "none"), None).otherwise(F.col("at_end")))


BUDGETS = [(0, "events", 0, 0, 5_000), (1, "events", 1, 33, 1), (2, "events", 2, 120, 20_000)]
BUDGET_VALUES = "requests(pos, topic, \"partition\", start_offset, max_bytes) AS (VALUES " + ", ".join(f"({p}, '{t}', {n}, {s}, {b})" for p, t, n, s, b in BUDGETS) + ")"


@query(f"""WITH {BATCHES}, {BUDGET_VALUES}, run AS (SELECT r.pos, r.max_bytes, b.*, CAST(sum(bytes) OVER w AS BIGINT) AS running_bytes, row_number() OVER w AS turn FROM batches b JOIN requests r USING (topic, "partition")
  WHERE last_offset >= start_offset WINDOW w AS (PARTITION BY pos ORDER BY base_offset ROWS UNBOUNDED PRECEDING))
SELECT pos, "partition", base_offset, last_offset, bytes, running_bytes FROM run WHERE running_bytes <= max_bytes OR turn = 1""")
def fetch_byte_budget(spark, d):
    own = _requests(spark, BUDGETS, "pos int, topic string, partition int, start_offset bigint, max_bytes bigint")
    return log.fetch_within_budget(c.event_batches(spark, d), own).select("pos", "partition", "base_offset", "last_offset", "bytes", "running_bytes")


@query(f"""WITH {LOG}, tiers AS (SELECT *, 0 AS rank, 'wal' AS tier FROM log WHERE "offset" >= 150 UNION ALL SELECT topic, "partition", "offset", timestamp_ms, key, 'old ' || value, event_type, event_id, user_id, 1, 'topic_wal' FROM log WHERE "offset" < 200),
turned AS (SELECT *, row_number() OVER (PARTITION BY topic, "partition", "offset" ORDER BY rank) AS turn FROM tiers)
SELECT topic, "partition", "offset", tier, value FROM turned WHERE turn = 1""")
def fetch_tier_merge(spark, d):
    own = c.event_log(spark, d).select("topic", "partition", "offset", "value")
    old = own.where("offset < 200").withColumn("value", F.concat(F.lit("old "), "value"))
    return log.merge_tiers(own.where("offset >= 150"), old)


SENTINELS = [(i, "events", p, at) for i, (p, at) in enumerate((p, at) for p in (0, 1, 3, 7) for at in (-1, -2))]
SENTINEL_VALUES = "requests(pos, topic, \"partition\", at_ms) AS (VALUES " + ", ".join(f"({i}, '{t}', {p}, {a})" for i, t, p, a in SENTINELS) + ")"


@query(f"""WITH {PARTITIONS}, {SENTINEL_VALUES} SELECT pos, topic, "partition", at_ms, CASE WHEN last_offset IS NULL THEN 'unknown_topic_or_partition' ELSE 'none' END AS error_code,
  CAST(NULL AS BIGINT) AS timestamp_ms, CASE WHEN at_ms = -2 THEN log_start_offset ELSE last_offset + 1 END AS "offset" FROM requests LEFT JOIN partitions USING (topic, "partition")""")
def list_offsets_sentinels(spark, d):
    return log.list_offsets(_requests(spark, SENTINELS, "pos int, topic string, partition int, at_ms bigint"), c.event_partitions(spark, d))


@query(f"""WITH {PARTITIONS}, bounds AS (SELECT min(timestamp_ms) AS low, max(timestamp_ms) AS high FROM log),
requests AS (SELECT p."partition" * 4 + k AS pos, 'events' AS topic, p."partition", CAST(CASE k WHEN 3 THEN high + 1 ELSE low + (high - low) * k // 3 END AS BIGINT) AS at_ms FROM bounds, (SELECT DISTINCT "partition" FROM log) p, (VALUES (0), (1), (2), (3)) v(k)),
found AS (SELECT pos, min(l."offset") AS off, arg_min(l.timestamp_ms, l."offset") AS ts FROM requests r JOIN log l USING (topic, "partition") JOIN partitions p USING (topic, "partition") WHERE l.timestamp_ms >= at_ms AND l."offset" >= log_start_offset GROUP BY pos)
SELECT pos, topic, "partition", at_ms, 'none' AS error_code, ts AS timestamp_ms, coalesce(off, last_offset + 1) AS "offset" FROM requests LEFT JOIN found USING (pos) JOIN partitions USING (topic, "partition")""")
def list_offsets_for_timestamp(spark, d):
    own = c.event_log(spark, d)
    bounds = own.agg(F.min("timestamp_ms").alias("low"), F.max("timestamp_ms").alias("high"))
    asked = bounds.select("low", "high", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("pos"))
    k = F.col("pos") % 4
    asked = asked.select("pos", F.lit("events").alias("topic"), F.floor(F.col("pos") / 4).cast("int").alias("partition"), F.when(k == 3, F.col("high") + 1).otherwise(F.col("low") + F.floor((F.col("high") - F.col("low")) * k / 3)).cast("long").alias("at_ms"))
    return log.list_offsets(asked, c.event_partitions(spark, d), own, c.event_segments(spark, d)).withColumn("pos", F.col("pos").cast("int"))


INTERNAL = """entries AS (SELECT CAST(event_id % 5 AS INT) AS "partition", row_number() OVER (PARTITION BY event_id % 5 ORDER BY event_id) + event_id % 5 AS log_offset FROM events)"""


@query(f"""WITH {INTERNAL}, parts AS (SELECT CAST(range AS INT) AS "partition" FROM range(8)), seen AS (SELECT "partition", min(log_offset) AS low, max(log_offset) AS high FROM entries GROUP BY ALL)
SELECT "partition", coalesce(low, 0) AS log_start_offset, coalesce(high, -1) AS last_offset FROM parts LEFT JOIN seen USING ("partition")""")
def internal_offset_bounds(spark, d):
    e = c.table(spark, d, "events").select((F.col("event_id") % 5).cast("int").alias("partition"), F.lit("x").alias("topic"), "event_id")
    rows = ingest.assign_offsets(e, order="event_id").select("partition", (F.col("offset") + 1 + F.col("partition")).alias("log_offset"))
    return log.internal_bounds(rows, spark.range(8).select(F.col("id").cast("int").alias("partition")))


# --- segments

SEGMENT_COLUMNS = ["topic", "partition", "segment_no", "base_offset", "last_offset", "bytes", "min_timestamp", "max_timestamp", "row_count", "total_messages"]


@query(f'WITH {SEGMENTS} SELECT topic, "partition", segment_no, base_offset, last_offset, bytes, min_timestamp, max_timestamp, row_count, total_messages FROM segments')
def segment_index(spark, d):
    return c.event_segments(spark, d).select(*SEGMENT_COLUMNS)


@query(f'WITH {BATCHES} SELECT * FROM batches')
def batch_index(spark, d):
    return c.event_batches(spark, d)


@query(f'WITH {SEGMENTS}, middle AS (SELECT (min(timestamp_ms) + max(timestamp_ms)) // 2 AS m FROM log) SELECT topic, "partition", segment_no, max_timestamp FROM segments, middle WHERE max_timestamp IS NULL OR max_timestamp >= m')
def segment_prune_time(spark, d):
    low, high = c.event_log(spark, d).agg(F.min("timestamp_ms"), F.max("timestamp_ms")).first()
    return segments.prune_by_time(c.event_segments(spark, d), (low + high) // 2).select("topic", "partition", "segment_no", "max_timestamp")


@query(f'WITH {SEGMENTS} SELECT topic, "partition", segment_no, base_offset, last_offset FROM segments WHERE last_offset >= 150 AND base_offset <= 420')
def segment_prune_offset(spark, d):
    return segments.prune_by_offset(c.event_segments(spark, d), 150, 420).select("topic", "partition", "segment_no", "base_offset", "last_offset")


@query(f"""WITH {SEGMENTS}, parts AS (SELECT topic, "partition", max("offset") AS last_offset, CAST(CASE WHEN "partition" % 2 = 1 THEN 5 ELSE 0 END AS BIGINT) AS log_start_offset FROM log GROUP BY ALL),
w AS (SELECT topic, "partition", count(*) AS n, min(base_offset) AS low, max(last_offset) AS high FROM segments WHERE tier = 'wal' GROUP BY ALL), t AS (SELECT topic, "partition", count(*) AS n, min(base_offset) AS low, max(last_offset) AS high FROM segments WHERE tier = 'topic_wal' GROUP BY ALL)
SELECT p.topic, p."partition", p.log_start_offset, p.last_offset, coalesce(w.n, 0) AS wal_count, w.low AS wal_min_offset, w.high AS wal_max_offset, coalesce(t.n, 0) AS topic_wal_count, t.low AS topic_wal_min_offset, t.high AS topic_wal_max_offset
FROM parts p LEFT JOIN w USING (topic, "partition") LEFT JOIN t USING (topic, "partition")""")
def topic_offset_visibility(spark, d):
    return segments.topic_offset_visibility(c.event_partitions(spark, d), c.event_segments(spark, d))


@query(f"""WITH {SEGMENTS}, two AS (SELECT topic, "partition", segment_no, tier, base_offset, last_offset + CASE WHEN segment_no % 7 = 3 THEN 30 ELSE 0 END AS last_offset FROM segments)
SELECT topic, "partition", segment_no, base_offset, previous_last FROM (SELECT *, max(last_offset) OVER (PARTITION BY topic, "partition", tier ORDER BY base_offset, last_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_last FROM two) WHERE base_offset <= previous_last""")
def segment_overlaps(spark, d):
    late = F.col("last_offset") + F.when(F.col("segment_no") % 7 == 3, 30).otherwise(0)
    return segments.overlaps(c.event_segments(spark, d).withColumn("last_offset", late)).select("topic", "partition", "segment_no", "base_offset", "previous_last")


# --- compaction

WAL_FILES = f"""{BATCHES}, files AS (SELECT batch_no AS file_id, CAST(sum(bytes) AS BIGINT) AS bytes FROM batches GROUP BY ALL)"""


def _wal_files(spark, d):
    return c.event_batches(spark, d).groupBy(F.col("batch_no").alias("file_id")).agg(F.sum("bytes").alias("bytes"))


@query(f"""WITH RECURSIVE {WAL_FILES}, numbered AS (SELECT *, row_number() OVER (ORDER BY file_id) AS k FROM files),
walk(k, file_id, bytes, n, size, taken) AS (SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), false UNION ALL
  SELECT x.k, x.file_id, x.bytes, CASE WHEN w.n < 40 AND w.size + x.bytes <= 150000 THEN w.n + 1 ELSE w.n END, CASE WHEN w.n < 40 AND w.size + x.bytes <= 150000 THEN w.size + x.bytes ELSE w.size END, w.n < 40 AND w.size + x.bytes <= 150000 FROM walk w JOIN numbered x ON x.k = w.k + 1)
SELECT file_id, bytes, taken FROM walk WHERE k > 0""")
def compaction_select(spark, d):
    return compaction.select_files(_wal_files(spark, d), most_files=40, most_bytes=150_000)


def _chunk_sql(before: bool) -> str:
    cut = "w.held > 0 AND w.held + x.bytes > 20000" if before else "w.held >= 20000"
    return f"""WITH RECURSIVE {BATCHES}, numbered AS (SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY base_offset) AS k FROM batches),
walk(p, k, base_offset, chunk, held) AS (SELECT "partition", k, base_offset, 0, bytes FROM numbered WHERE k = 1 UNION ALL
  SELECT x."partition", x.k, x.base_offset, CASE WHEN {cut} THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN {cut} THEN x.bytes ELSE w.held + x.bytes END FROM walk w JOIN numbered x ON x."partition" = w.p AND x.k = w.k + 1)
SELECT p AS "partition", base_offset, chunk FROM walk"""


@query(_chunk_sql(True))
def compaction_chunks(spark, d):
    return compaction.chunk_before(c.event_batches(spark, d), 20_000).select("partition", "base_offset", "chunk")


@query(_chunk_sql(False))
def compaction_row_chunks(spark, d):
    return compaction.chunk_after(c.event_batches(spark, d), 20_000, order="base_offset").select("partition", "base_offset", "chunk")


@query(f"""WITH {SEGMENTS}, run AS (SELECT topic, "partition", segment_no AS file_id, base_offset AS min_offset, bytes, max_timestamp AS created_ms, CAST(sum(bytes) OVER w AS BIGINT) AS running, row_number() OVER w AS turn FROM segments WINDOW w AS (PARTITION BY topic, "partition" ORDER BY base_offset ROWS UNBOUNDED PRECEDING)),
pick AS (SELECT topic, "partition", min(turn) FILTER (running >= 40000 * ("partition" + 1) AND turn >= 2 AND turn <= 9) AS by_size, min(created_ms) FILTER (turn <= 9) AS oldest, count(*) AS n FROM run GROUP BY ALL)
SELECT r.topic, r."partition", file_id, turn, CASE WHEN by_size IS NOT NULL THEN 'size' ELSE 'age' END AS "trigger" FROM run r JOIN pick USING (topic, "partition") WHERE turn <= coalesce(by_size, CASE WHEN oldest <= 2000000000000 AND n >= 2 THEN least(n, 9) END)""")
def compaction_buckets(spark, d):
    files = c.event_segments(spark, d).select("topic", "partition", F.col("segment_no").alias("file_id"), F.col("base_offset").alias("min_offset"), "bytes", F.col("max_timestamp").alias("created_ms"))
    parts = None
    for p in range(4):  # a target for each partition, to meet both triggers
        own = compaction.pick_buckets(files.where(F.col("partition") == p), target_bytes=40_000 * (p + 1), least_files=2, most_files=9, now_ms=2_000_000_003_600_000 // 1000, force_age_ms=3_600)
        parts = own if parts is None else parts.unionByName(own)
    return parts.select("topic", "partition", "file_id", "turn", "trigger")


@query(f"""WITH RECURSIVE {SEGMENTS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY base_offset) AS k FROM segments),
walk(p, k, segment_no, chunk, held) AS (SELECT "partition", k, segment_no, 0, bytes FROM numbered WHERE k = 1 UNION ALL
  SELECT x."partition", x.k, x.segment_no, CASE WHEN w.held >= 30000 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.held >= 30000 THEN x.bytes ELSE w.held + x.bytes END FROM walk w JOIN numbered x ON x."partition" = w.p AND x.k = w.k + 1)
SELECT topic, "partition", chunk, min(base_offset) AS min_offset, max(last_offset) AS max_offset, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(row_count) AS BIGINT) AS row_count, min(min_timestamp) AS min_timestamp, max(max_timestamp) AS max_timestamp,
  max(s.segment_no % 3) + 1 AS generation, count(*) AS parent_count FROM walk JOIN segments s ON s."partition" = p AND s.segment_no = walk.segment_no GROUP BY topic, "partition", chunk""")
def parquet_merge_plan(spark, d):
    files = c.event_segments(spark, d).select("topic", "partition", F.col("segment_no").alias("file_id"), F.col("base_offset").alias("min_offset"), F.col("last_offset").alias("max_offset"), "bytes", "row_count", "min_timestamp", "max_timestamp", (F.col("segment_no") % 3).alias("generation"))
    return compaction.merge_plan(files, 30_000).withColumn("parent_count", F.size("parents")).drop("parents")


@query("SELECT p AS \"partition\", chunk, base_offset // 100 AS file_id FROM (" + _chunk_sql(True).replace('SELECT p AS "partition", base_offset, chunk FROM walk', "SELECT * FROM walk") + ") GROUP BY ALL")
def lineage_edges(spark, d):
    batches = c.event_batches(spark, d).withColumn("file_id", F.floor(F.col("base_offset") / 100))
    return compaction.wal_to_topic_segments(batches, 20_000).lineage.select("partition", "chunk", "file_id")


@query(f"""WITH {WAL_FILES} SELECT file_id, CASE WHEN file_id % 10 = 0 THEN 7 WHEN file_id % 3 = 0 THEN {NOW} END AS compacted_at FROM files""")
def tombstoned_sources(spark, d):
    files = _wal_files(spark, d).withColumn("compacted_at", F.when(F.col("file_id") % 10 == 0, 7))
    return compaction.tombstone(files, files.where("file_id % 3 = 0"), NOW).select("file_id", "compacted_at")


# --- ingest

PRODUCED = """sent AS (SELECT event_id, CAST(user_id % 4 AS INT) AS "partition", user_id AS producer_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events)"""


@query(f"""WITH b AS (SELECT event_id, CASE event_id % 11 WHEN 0 THEN '__consumer_offsets' WHEN 1 THEN 'nope' ELSE 'events' END AS topic, event_id % 7 <> 0 AS parsed, CASE WHEN event_id % 13 = 0 THEN 1 ELSE 2 END AS magic, event_id % 5 AS row_count, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS producer_id, event_id % 2 AS producer_epoch FROM events)
SELECT event_id, CASE WHEN starts_with(topic, '__') THEN 'topic_authorization_failed' WHEN NOT parsed THEN 'invalid_record' WHEN magic <> 2 THEN 'unsupported_for_message_format' WHEN row_count = 0 THEN 'none' WHEN topic = 'nope' THEN 'unknown_topic_or_partition'
  WHEN producer_id >= 0 AND producer_id % 10 = 0 THEN 'unknown_producer_id' WHEN producer_id >= 0 AND producer_epoch <> producer_id % 2 THEN 'invalid_producer_epoch' ELSE 'none' END AS error_code FROM b""")
def produce_validate(spark, d):
    e = c.table(spark, d, "events")
    k = F.col("event_id")
    b = e.select(
        "event_id", F.when(k % 11 == 0, "__consumer_offsets").when(k % 11 == 1, "nope").otherwise("events").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), (k % 7 != 0).alias("parsed"), F.when(k % 13 == 0, 1).otherwise(2).alias("magic"),
        (k % 5).alias("row_count"), F.when(k % 3 == 0, -1).otherwise(F.col("user_id")).alias("producer_id"), (k % 2).alias("producer_epoch"), F.lit(0).alias("base_sequence"),
    )
    sessions = e.select(F.col("user_id").alias("producer_id")).distinct().where("producer_id % 10 <> 0").withColumn("producer_epoch", F.col("producer_id") % 2)
    return ingest.validate(b, c.event_partitions(spark, d), sessions).select("event_id", "error_code")


@query(f"""WITH {PARTITIONS}, b AS (SELECT event_id, CAST(user_id % 4 AS INT) AS "partition", event_id % 3 + 1 AS row_count FROM events)
SELECT event_id, "partition", row_count, CAST(last_offset + 1 + coalesce(sum(row_count) OVER w, 0) AS BIGINT) AS base_offset, CAST(last_offset + coalesce(sum(row_count) OVER w, 0) + row_count AS BIGINT) AS last_offset
FROM b JOIN partitions USING ("partition") WINDOW w AS (PARTITION BY "partition" ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def produce_assign_offsets(spark, d):
    b = c.table(spark, d, "events").select("event_id", F.lit("events").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), (F.col("event_id") % 3 + 1).alias("row_count"))
    return ingest.assign_batch_offsets(b, c.event_partitions(spark, d), order="event_id").select("event_id", "partition", "row_count", "base_offset", "last_offset")


def _arrivals(spark, d):
    """Each event as a batch of one record; some come twice, some never."""
    e = c.event_log(spark, d).select("topic", "partition", F.col("user_id").alias("producer_id"), "event_id")
    sent = ingest.assign_offsets(e.withColumn("own", F.col("partition")).withColumn("topic", F.col("producer_id").cast("string")), order="event_id").withColumnRenamed("offset", "base_sequence")
    sent = sent.where("event_id % 101 <> 0").withColumn("copy", F.explode(F.when(F.col("event_id") % 17 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return sent.select(F.lit("events").alias("topic"), "partition", "producer_id", F.lit(0).alias("producer_epoch"), "base_sequence", F.col("base_sequence").alias("last_sequence"), F.lit(1).alias("row_count"), (F.col("event_id") * 2 + F.col("copy")).alias("arrival"))


@query(f"""WITH {PRODUCED}, gaps AS (SELECT producer_id, min(seq) AS gap FROM sent WHERE event_id % 101 = 0 GROUP BY ALL),
came AS (SELECT *, 0 AS copy FROM sent WHERE event_id % 101 <> 0 UNION ALL SELECT *, 1 FROM sent WHERE event_id % 101 <> 0 AND event_id % 17 = 0),
told AS (SELECT c.*, event_id * 2 + copy AS arrival, CASE WHEN seq > coalesce(gap, 1e18) THEN 'out_of_order_sequence_number' WHEN copy = 1 THEN 'duplicate' ELSE 'appended' END AS outcome FROM came c LEFT JOIN gaps USING (producer_id)),
placed AS (SELECT event_id, row_number() OVER (PARTITION BY "partition" ORDER BY arrival) - 1 AS first_offset FROM told WHERE outcome = 'appended')
SELECT arrival, "partition", producer_id, seq AS base_sequence, outcome, CASE WHEN outcome <> 'out_of_order_sequence_number' THEN first_offset END AS first_offset FROM told LEFT JOIN placed USING (event_id)""")
def produce_idempotent(spark, d):
    return ingest.idempotent_append(_arrivals(spark, d), order="arrival").select("arrival", "partition", "producer_id", "base_sequence", "outcome", "first_offset")


@query(f"""WITH {PRODUCED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY producer_id, "partition" ORDER BY seq DESC) AS k FROM sent) SELECT producer_id, "partition", seq AS base_sequence FROM ranked WHERE k <= 5""")
def recent_batches_topn(spark, d):
    e = c.event_log(spark, d).select("partition", F.col("user_id").alias("producer_id"), F.col("user_id").cast("string").alias("topic"), "event_id")
    sent = ingest.assign_offsets(e, order="event_id").withColumn("producer_epoch", F.lit(0)).withColumnRenamed("offset", "base_sequence")
    return ingest.recent_batches(sent, 5).select("producer_id", "partition", "base_sequence")


@query("""WITH r AS (SELECT event_id AS request_no, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN ' ' || event_type || ' ' ELSE '  ' END AS t FROM events), o AS (SELECT request_no, nullif(trim(t), '') AS name FROM r),
own AS (SELECT *, coalesce('t' || name, 'r' || request_no) AS o FROM o), firsts AS (SELECT o, row_number() OVER (ORDER BY min(request_no)) AS producer_id FROM own GROUP BY o)
SELECT request_no, producer_id, CAST((row_number() OVER (PARTITION BY o ORDER BY request_no) - 1) % 32768 AS INT) AS producer_epoch FROM own JOIN firsts USING (o)""")
def producer_ids(spark, d):
    k = F.col("event_id")
    asked = c.table(spark, d, "events").select(k.alias("request_no"), F.when(k % 3 == 1, F.concat(F.lit(" "), "event_type", F.lit(" "))).when(k % 3 == 2, F.lit("  ")).alias("transactional_id"))
    return ingest.allocate_producer_ids(asked).select("request_no", "producer_id", "producer_epoch")


@query("""WITH s AS (SELECT user_id AS producer_id, max(event_id) AS last_seen_ms, CASE WHEN user_id % 4 = 0 THEN max(event_id) + 50 END AS expires_at_ms FROM events GROUP BY user_id), n AS (SELECT max(event_id) AS now FROM events)
SELECT producer_id FROM s, n WHERE NOT coalesce(CASE WHEN expires_at_ms IS NOT NULL THEN expires_at_ms < now ELSE last_seen_ms < now - 100 END, false)""")
def producer_ttl(spark, d):
    e = c.table(spark, d, "events")
    now = e.agg(F.max("event_id")).first()[0]
    s = e.groupBy(F.col("user_id").alias("producer_id")).agg(F.max("event_id").alias("last_seen_ms")).withColumn("expires_at_ms", F.when(F.col("producer_id") % 4 == 0, F.col("last_seen_ms") + 50))
    return ingest.live_sessions(s, now, 100).select("producer_id")


# --- consumer offsets

COMMITS = f"""{LOG}, commits AS (SELECT event_type AS group_id, topic, "partition", event_id AS log_offset, CASE WHEN event_id % 97 <> 0 THEN "offset" + 1 END AS committed_offset FROM log),
latest AS (SELECT group_id, topic, "partition", max(log_offset) AS log_offset, arg_max(struct_pack(x := committed_offset), log_offset).x AS committed_offset FROM commits GROUP BY ALL)"""


def _commits(spark, d):
    own = c.event_log(spark, d)
    return own.select(F.col("event_type").alias("group_id"), "topic", "partition", F.col("event_id").alias("log_offset"), F.when(F.col("event_id") % 97 != 0, F.col("offset") + 1).alias("committed_offset"))


@query(f"WITH {COMMITS} SELECT * FROM latest WHERE committed_offset IS NOT NULL")
def offsets_current(spark, d):
    return offsets.current(_commits(spark, d))


@query(f"""WITH {COMMITS}, shifted AS (SELECT group_id, topic, "partition", log_offset, CASE WHEN (log_offset + "partition") % 3 <> 0 THEN committed_offset END AS committed_offset FROM commits),
l AS (SELECT group_id, topic, "partition", max(log_offset) AS log_offset, arg_max(struct_pack(x := committed_offset), log_offset).x AS committed_offset FROM shifted GROUP BY ALL) SELECT group_id, topic, "partition", log_offset FROM l WHERE committed_offset IS NULL""")
def offsets_tombstones(spark, d):
    own = _commits(spark, d).withColumn("committed_offset", F.when((F.col("log_offset") + F.col("partition")) % 3 != 0, F.col("committed_offset")))
    return offsets.tombstones(own).select("group_id", "topic", "partition", "log_offset")


OFFSET_ASKS = [(0, "view", "events", 0), (1, "view", "events", 7), (2, "nobody", "events", 0), (3, "click", "other", 1), (4, "error", "events", 3)]
ASK_VALUES = "asks(pos, group_id, topic, \"partition\") AS (VALUES " + ", ".join(f"({p}, '{g}', '{t}', {n})" for p, g, t, n in OFFSET_ASKS) + ")"


@query(f"""WITH {COMMITS}, {ASK_VALUES}, known AS (SELECT DISTINCT event_type AS group_id, 1 AS k FROM events) SELECT pos, a.group_id, a.topic, a."partition", CASE WHEN k IS NULL THEN 'group_id_not_found' ELSE 'none' END AS error_code, coalesce(committed_offset, -1) AS committed_offset
FROM asks a LEFT JOIN known USING (group_id) LEFT JOIN latest l ON l.group_id = a.group_id AND l.topic = a.topic AND l."partition" = a."partition" AND committed_offset IS NOT NULL""")
def offset_fetch(spark, d):
    known = c.table(spark, d, "events").select(F.col("event_type").alias("group_id")).distinct()
    return offsets.fetch_offsets(_requests(spark, OFFSET_ASKS, "pos int, group_id string, topic string, partition int"), known, offsets.current(_commits(spark, d)))


@query(f"""WITH {COMMITS}, ends AS (SELECT topic, "partition", max("offset") + 1 AS log_end_offset FROM log GROUP BY ALL), own AS (SELECT DISTINCT group_id, topic FROM latest WHERE committed_offset IS NOT NULL)
SELECT o.group_id, o.topic, e."partition", log_end_offset, committed_offset, log_end_offset - committed_offset AS lag FROM own o JOIN ends e USING (topic) LEFT JOIN latest l ON l.group_id = o.group_id AND l.topic = o.topic AND l."partition" = e."partition" AND committed_offset IS NOT NULL""")
def consumer_lag(spark, d):
    known = c.table(spark, d, "events").select(F.col("event_type").alias("group_id")).distinct()
    return offsets.lag(offsets.current(_commits(spark, d)).where("partition <> -1"), c.event_partitions(spark, d), known)


@query(f"""WITH {COMMITS}, own AS (SELECT log_offset AS seq, committed_offset, '0001' || printf('%04X', octet_length(encode(group_id))) || hex(encode(group_id)) || printf('%04X', octet_length(encode(topic))) || hex(encode(topic)) || printf('%08X', "partition") AS hx FROM commits), {murmur_sql("own", 50)}
SELECT seq, slot AS topic_partition, row_number() OVER (PARTITION BY slot ORDER BY seq) - 1 AS log_offset, hx AS key_hex, CASE WHEN committed_offset IS NOT NULL THEN '0001' || printf('%016X', committed_offset) || 'FFFF' || printf('%016X', seq) || repeat('F', 16) END AS value_hex FROM hashed""")
def offset_changelog_partitions(spark, d):
    entries = _commits(spark, d).withColumn("metadata", F.lit(None).cast("string")).withColumn("commit_ms", F.col("log_offset")).withColumnRenamed("log_offset", "seq")
    return offsets.encode_changelog(entries).select("seq", "topic_partition", "log_offset", F.hex("key_bytes").alias("key_hex"), F.hex("value_bytes").alias("value_hex"))


# --- groups

MEMBERS = f"""members AS (SELECT 'g' || c_nationkey AS group_id, c_name AS member_id, c_custkey, CASE WHEN c_custkey % 13 <> 0 THEN {NOW} - c_custkey * 7 % 20011 END AS last_heartbeat_ms, 5000 + 1000 * (c_custkey % 7) AS session_timeout_ms, 20000 + c_custkey % 11 * 1000 AS rebalance_timeout_ms, c_custkey % 3 AS member_generation, c_custkey % 9 <> 0 AS is_in_sync FROM customer WHERE c_nationkey < 22),
groups AS (SELECT 'g' || n_nationkey AS group_id, n_nationkey % 3 AS generation, CASE n_nationkey % 5 WHEN 0 THEN 'Empty' WHEN 1 THEN 'PreparingRebalance' WHEN 2 THEN 'CompletingRebalance' ELSE 'Stable' END AS state, CASE WHEN n_nationkey % 2 = 0 THEN 'range' ELSE 'sticky' END AS protocol, {NOW} - 500 + n_nationkey * 40 AS sync_deadline_ms FROM nation)"""
GONE = f"coalesce({NOW} - last_heartbeat_ms > greatest(1, session_timeout_ms), true)"
LISTED = """protocols AS (SELECT 'g' || c_nationkey AS group_id, c_name AS member_id, name, CAST((k + c_custkey) % 3 AS INT) AS rank FROM customer, (VALUES (0, 'range'), (1, 'roundrobin'), (2, 'sticky')) v(k, name) WHERE NOT (name = 'sticky' AND c_nationkey % 2 = 0 AND c_custkey % 5 = 0))"""


def _members(spark, d):
    k = F.col("c_custkey")
    return c.table(spark, d, "customer").where("c_nationkey < 22").select(
        F.concat(F.lit("g"), F.col("c_nationkey").cast("string")).alias("group_id"), F.col("c_name").alias("member_id"), "c_custkey", F.when(k % 13 != 0, NOW - k * 7 % 20011).alias("last_heartbeat_ms"),
        (5000 + 1000 * (k % 7)).alias("session_timeout_ms"), (20000 + k % 11 * 1000).alias("rebalance_timeout_ms"), (k % 3).alias("member_generation"), (k % 9 != 0).alias("is_in_sync"),
    )


def _groups(spark, d):
    k = F.col("n_nationkey")
    state = F.when(k % 5 == 0, "Empty").when(k % 5 == 1, "PreparingRebalance").when(k % 5 == 2, "CompletingRebalance").otherwise("Stable")
    return c.table(spark, d, "nation").select(F.concat(F.lit("g"), k.cast("string")).alias("group_id"), (k % 3).alias("generation"), state.alias("state"), F.when(k % 2 == 0, "range").otherwise("sticky").alias("protocol"), (NOW - 500 + k * 40).alias("sync_deadline_ms"))


def _protocols(spark, d):
    listed = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.lit(n).alias("name")) for i, n in enumerate(("range", "roundrobin", "sticky"))))).alias("p")
    out = c.table(spark, d, "customer").select("c_nationkey", "c_custkey", F.col("c_name").alias("member_id"), listed)
    out = out.where(~((F.col("p.name") == "sticky") & (F.col("c_nationkey") % 2 == 0) & (F.col("c_custkey") % 5 == 0)))
    return out.select(F.concat(F.lit("g"), F.col("c_nationkey").cast("string")).alias("group_id"), "member_id", F.col("p.name").alias("name"), ((F.col("p.k") + F.col("c_custkey")) % 3).cast("int").alias("rank"), F.concat(F.lit("m-"), "p.name", F.lit("-"), "member_id").alias("metadata"))


@query(f"""WITH {LISTED}, n AS (SELECT group_id, count(DISTINCT member_id) AS n FROM protocols GROUP BY ALL), common AS (SELECT group_id, name FROM protocols JOIN n USING (group_id) GROUP BY group_id, name, n HAVING count(DISTINCT member_id) = n),
listed AS (SELECT p.*, row_number() OVER (PARTITION BY group_id, member_id ORDER BY rank, name) AS k FROM protocols p JOIN common USING (group_id, name)), tally AS (SELECT group_id, name, count(*) FILTER (k = 1) AS votes, CAST(sum(rank) AS BIGINT) AS rank_sum FROM listed GROUP BY ALL)
SELECT group_id, name AS protocol, votes, rank_sum FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY votes DESC, rank_sum, name) AS k FROM tally) WHERE k = 1""")
def protocol_vote(spark, d):
    return groups.protocol_vote(_protocols(spark, d))


@query(f"""WITH {MEMBERS}, led AS (SELECT group_id, CASE WHEN generation = 0 THEN 'nobody' ELSE (SELECT max(member_id) FROM members m WHERE m.group_id = groups.group_id) END AS leader FROM groups)
SELECT group_id, CASE WHEN EXISTS (SELECT 1 FROM members m WHERE m.group_id = led.group_id AND m.member_id = leader) THEN leader ELSE (SELECT min(member_id) FROM members m WHERE m.group_id = led.group_id) END AS leader_member_id FROM led""")
def leader_election(spark, d):
    m = _members(spark, d)
    top = m.groupBy("group_id").agg(F.max("member_id").alias("top"))
    g = _groups(spark, d).join(top, "group_id", "left").withColumn("leader_member_id", F.when(F.col("generation") == 0, "nobody").otherwise(F.col("top"))).drop("top")
    return groups.elect_leaders(g, m)


@query(f"""WITH {MEMBERS} SELECT group_id, CAST(coalesce(t, 30000) AS BIGINT) AS rebalance_timeout_ms, {NOW} + least(CAST(coalesce(t, 30000) AS BIGINT), 120000) AS deadline_ms FROM groups LEFT JOIN (SELECT group_id, min(rebalance_timeout_ms) AS t FROM members WHERE NOT {GONE} GROUP BY group_id) USING (group_id)""")
def rebalance_timeout(spark, d):
    return groups.rebalance_timeouts(_groups(spark, d), _members(spark, d), NOW)


@query(f"WITH {MEMBERS} SELECT group_id, member_id, last_heartbeat_ms FROM members WHERE {GONE}")
def expired_members(spark, d):
    return groups.expired_members(_members(spark, d), NOW).select("group_id", "member_id", "last_heartbeat_ms")


@query(f"""WITH {MEMBERS}, n AS (SELECT group_id, count(*) FILTER ({GONE}) AS expired, count(*) FILTER (NOT {GONE}) AS members FROM members WHERE group_id <> 'g3' OR {GONE} GROUP BY group_id), j AS (SELECT g.group_id, generation, state, coalesce(expired, 0) AS expired, coalesce(members, 0) AS members FROM groups g LEFT JOIN n USING (group_id))
SELECT group_id, generation, CASE WHEN expired = 0 THEN state WHEN members = 0 THEN 'Empty' WHEN state IN ('Stable', 'CompletingRebalance', 'Empty') THEN 'PreparingRebalance' ELSE state END AS state, expired, members FROM j""")
def group_state_after_expiry(spark, d):
    m = _members(spark, d)
    m = m.where((F.col("group_id") != "g3") | groups.expired(NOW, F.col("last_heartbeat_ms"), F.col("session_timeout_ms")))
    return groups.state_after_expiry(_groups(spark, d), m, NOW)


@query(f"""WITH {MEMBERS} SELECT group_id, CASE WHEN state = 'CompletingRebalance' AND sync_deadline_ms < {NOW} THEN 'PreparingRebalance' ELSE state END AS state FROM groups""")
def sync_deadline_reset(spark, d):
    return groups.sync_timeout(_groups(spark, d), NOW).select("group_id", "state")


@query(f"""WITH {MEMBERS}, s AS (SELECT group_id, bool_and(is_in_sync OR group_id IN ('g2', 'g12')) AS a FROM members GROUP BY group_id) SELECT group_id, CASE WHEN state = 'CompletingRebalance' AND coalesce(a, false) THEN 'Stable' ELSE state END AS state FROM groups LEFT JOIN s USING (group_id)""")
def group_completion(spark, d):
    return groups.complete_groups(_groups(spark, d), _members(spark, d).withColumn("is_in_sync", F.col("is_in_sync") | F.col("group_id").isin("g2", "g12"))).select("group_id", "state")


@query(f"""WITH {MEMBERS}, asks AS (SELECT c_custkey AS pos, CASE WHEN c_custkey % 17 = 0 THEN 'g99' ELSE group_id END AS group_id, CASE WHEN c_custkey % 19 = 0 THEN 'x' ELSE member_id END AS member_id, (c_custkey // 3) % 3 AS generation FROM members)
SELECT pos, a.group_id, a.member_id, a.generation, CASE WHEN g.state IS NULL THEN 'group_id_not_found' WHEN m.member_id IS NULL OR {GONE} THEN 'unknown_member_id' WHEN a.generation <> g.generation THEN 'illegal_generation' WHEN m.member_generation <> g.generation THEN 'illegal_generation'
  WHEN g.state IN ('PreparingRebalance', 'CompletingRebalance') THEN 'rebalance_in_progress' WHEN g.state <> 'Stable' THEN 'unknown_member_id' ELSE 'none' END AS error_code FROM asks a LEFT JOIN groups g ON g.group_id = a.group_id LEFT JOIN members m ON m.group_id = a.group_id AND m.member_id = a.member_id""")
def heartbeat_ladder(spark, d):
    m = _members(spark, d)
    return groups.heartbeat_check(_asks(m), _groups(spark, d), m, NOW)


def _asks(m):
    k = F.col("c_custkey")
    return m.select(k.alias("pos"), F.when(k % 17 == 0, "g99").otherwise(F.col("group_id")).alias("group_id"), F.when(k % 19 == 0, "x").otherwise(F.col("member_id")).alias("member_id"), (F.floor(k / 3) % 3).alias("generation"), F.when(k % 2 == 0, "range").otherwise("sticky").alias("protocol"))


@query(f"""WITH {MEMBERS}, asks AS (SELECT c_custkey AS pos, CASE WHEN c_custkey % 17 = 0 THEN 'g99' ELSE group_id END AS group_id, CASE WHEN c_custkey % 19 = 0 THEN 'x' ELSE member_id END AS member_id, (c_custkey // 3) % 3 AS generation, CASE WHEN c_custkey % 2 = 0 THEN 'range' ELSE 'sticky' END AS protocol FROM members)
SELECT pos, a.group_id, a.member_id, a.generation, CASE WHEN g.state IS NULL THEN 'group_id_not_found' WHEN a.generation <> g.generation THEN 'illegal_generation' WHEN m.member_id IS NULL OR {GONE} THEN 'unknown_member_id' WHEN m.member_generation <> g.generation THEN 'illegal_generation'
  WHEN g.state = 'PreparingRebalance' THEN 'rebalance_in_progress' WHEN g.state NOT IN ('CompletingRebalance', 'Stable') THEN 'unknown_member_id' WHEN a.protocol <> g.protocol THEN 'inconsistent_group_protocol' ELSE 'none' END AS error_code
FROM asks a LEFT JOIN groups g ON g.group_id = a.group_id LEFT JOIN members m ON m.group_id = a.group_id AND m.member_id = a.member_id""")
def sync_ladder(spark, d):
    m = _members(spark, d)
    return groups.sync_check(_asks(m), _groups(spark, d), m, NOW)


LEAVING = f"""{MEMBERS}, asks AS (SELECT c_custkey AS pos, CASE WHEN c_custkey % 17 = 0 THEN 'g99' ELSE group_id END AS group_id, CASE WHEN c_custkey % 19 = 0 THEN 'x' ELSE member_id END AS member_id FROM members WHERE c_custkey % 3 = 0 OR group_id = 'g4'),
results AS (SELECT pos, a.group_id, a.member_id, CASE WHEN g.group_id IS NULL THEN 'group_id_not_found' WHEN m.member_id IS NULL THEN 'unknown_member_id' ELSE 'none' END AS error_code FROM asks a LEFT JOIN groups g ON g.group_id = a.group_id LEFT JOIN members m ON m.group_id = a.group_id AND m.member_id = a.member_id)"""


def _leave(spark, d):
    m = _members(spark, d)
    return groups.leave(_asks(m.where("c_custkey % 3 = 0 or group_id = 'g4'")).select("pos", "group_id", "member_id"), _groups(spark, d), m)


@query(f"WITH {LEAVING} SELECT * FROM results")
def leave_results(spark, d):
    return _leave(spark, d)[0]


@query(f"""WITH {LEAVING}, gone AS (SELECT DISTINCT group_id, member_id FROM results WHERE error_code = 'none'), n AS (SELECT group_id, count(*) AS members FROM members m WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.group_id = m.group_id AND g.member_id = m.member_id) GROUP BY group_id)
SELECT g.group_id, CAST(CASE WHEN l.group_id IS NOT NULL AND coalesce(members, 0) = 0 THEN generation + 1 ELSE generation END AS INT) AS generation, CASE WHEN l.group_id IS NULL THEN state WHEN coalesce(members, 0) = 0 THEN 'Empty' ELSE 'PreparingRebalance' END AS state, coalesce(members, 0) AS members
FROM groups g LEFT JOIN (SELECT DISTINCT group_id FROM gone) l USING (group_id) LEFT JOIN n USING (group_id)""")
def groups_after_leave(spark, d):
    return _leave(spark, d)[1]


@query(f"""WITH {MEMBERS}, assigned AS (SELECT group_id, CASE WHEN c_custkey % 23 = 0 THEN 'x' ELSE member_id END AS member_id FROM members WHERE c_custkey % 29 <> 0 UNION ALL SELECT group_id, member_id FROM members WHERE c_custkey % 31 = 0),
a AS (SELECT group_id, member_id, count(*) AS n FROM assigned GROUP BY ALL), b AS (SELECT coalesce(m.group_id, a.group_id) AS group_id, m.member_id AS m, a.n FROM (SELECT group_id, member_id FROM members) m FULL JOIN a ON a.group_id = m.group_id AND a.member_id = m.member_id)
SELECT group_id, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (m IS NULL) AS unknown, count(*) FILTER (n > 1) AS repeated FROM b GROUP BY group_id HAVING count(*) FILTER (n IS NULL OR m IS NULL OR n > 1) > 0""")
def assignment_mismatch(spark, d):
    m, k = _members(spark, d), F.col("c_custkey")
    assigned = m.where(k % 29 != 0).select("group_id", F.when(k % 23 == 0, "x").otherwise(F.col("member_id")).alias("member_id")).union(m.where(k % 31 == 0).select("group_id", "member_id"))
    return groups.assignment_mismatch(assigned, m)


@query(f"WITH {MEMBERS}, {LISTED} SELECT m.group_id, m.member_id, g.protocol, 'm-' || name || '-' || m.member_id AS metadata FROM members m JOIN groups g USING (group_id) JOIN protocols p ON p.group_id = m.group_id AND p.member_id = m.member_id AND p.name = g.protocol")
def leader_member_metadata(spark, d):
    return groups.leader_metadata(_groups(spark, d), _members(spark, d), _protocols(spark, d))


# --- catalogue

TOPICS = """topics AS (SELECT DISTINCT p_brand AS topic FROM part), tparts AS (SELECT DISTINCT p_brand AS topic, CAST(p_size AS INT) AS "partition" FROM part)"""


def _topics(spark, d):
    p = c.table(spark, d, "part")
    return p.select(F.col("p_brand").alias("topic")).distinct(), p.select(F.col("p_brand").alias("topic"), F.col("p_size").cast("int").alias("partition")).distinct()


NEW = """asks AS (SELECT p_partkey AS pos, CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN '__own' WHEN 2 THEN p_brand ELSE 'new' || p_partkey % 40 END AS name, p_size - 3 AS partitions, CASE WHEN p_partkey % 7 = 0 THEN 3 WHEN p_partkey % 2 = 0 THEN -1 ELSE 1 END AS replication FROM part)"""


def _asked_topics(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 9 == 0, "").when(k % 9 == 1, "__own").when(k % 9 == 2, F.col("p_brand")).otherwise(F.concat(F.lit("new"), (k % 40).cast("string")))
    return c.table(spark, d, "part").select(k.alias("pos"), name.alias("name"), (F.col("p_size") - 3).alias("partitions"), F.when(k % 7 == 0, 3).when(k % 2 == 0, -1).otherwise(1).alias("replication"))


@query(f"""WITH {TOPICS}, {NEW}, turned AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos) AS k FROM asks) SELECT pos, name, partitions, CASE WHEN starts_with(name, '__') THEN 'topic_authorization_failed' WHEN name = '' THEN 'invalid_topic_exception' WHEN partitions <= 0 THEN 'invalid_partitions'
  WHEN replication NOT IN (-1, 1) THEN 'invalid_replication_factor' WHEN name IN (SELECT topic FROM topics) OR k > 1 THEN 'topic_already_exists' ELSE 'none' END AS error_code FROM turned""")
def create_topics_result(spark, d):
    return catalog.create_topics(_asked_topics(spark, d), _topics(spark, d)[0])


@query(f"""WITH {TOPICS}, {NEW}, turned AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos) AS k FROM asks) SELECT pos, name, CASE WHEN name = '' OR k > 1 THEN 'invalid_request' WHEN starts_with(name, '__') THEN 'topic_authorization_failed' WHEN name NOT IN (SELECT topic FROM topics) THEN 'unknown_topic_or_partition' ELSE 'none' END AS error_code FROM turned""")
def delete_topics_result(spark, d):
    return catalog.delete_topics(_asked_topics(spark, d), _topics(spark, d)[0])


@query(f'WITH {TOPICS} SELECT topic, len(list("partition")) AS n, min("partition") AS low, max("partition") AS high, false AS is_internal FROM tparts GROUP BY topic')
def topic_metadata(spark, d):
    return catalog.metadata(_topics(spark, d)[1]).select("topic", F.size("partitions").alias("n"), F.array_min("partitions").alias("low"), F.array_max("partitions").alias("high"), "is_internal")


@query(f'WITH {TOPICS} SELECT topic, (SELECT count(*) FROM tparts p WHERE p.topic = t.topic) AS partition_count, (SELECT count(*) FROM topics) AS total FROM (SELECT topic FROM topics ORDER BY topic LIMIT 7 OFFSET 5) t')
def list_topics_page(spark, d):
    return catalog.list_topics(*_topics(spark, d), 7, 5)


@query(f"WITH {MEMBERS} SELECT group_id, state, (SELECT count(*) FROM members m WHERE m.group_id = g.group_id) AS member_count, (SELECT count(*) FROM groups WHERE lower(state) IN ('stable', 'empty')) AS total FROM (SELECT * FROM groups WHERE lower(state) IN ('stable', 'empty') ORDER BY group_id LIMIT 6 OFFSET 2) g")
def list_groups_page(spark, d):
    return catalog.list_groups(_groups(spark, d), _members(spark, d), 6, 2, ("Stable", "empty")).select("group_id", "state", "member_count", "total")


DESCRIBED = ["g1", "g77", "g4", "g23", "g3"]


@query(f"""WITH {MEMBERS}, assignments AS (SELECT 'g' || s_nationkey AS group_id, CAST(s_suppkey % 3 AS INT) AS generation FROM supplier), asks(pos, group_id) AS (VALUES {", ".join(f"({i}, '{g}')" for i, g in enumerate(DESCRIBED))})
SELECT pos, a.group_id, CASE WHEN g.state IS NULL THEN 'group_id_not_found' ELSE 'none' END AS error_code, coalesce(g.state, 'Dead') AS state, g.generation, (SELECT count(*) FROM members m WHERE m.group_id = a.group_id) AS member_count,
  (SELECT count(*) FROM assignments x WHERE x.group_id = a.group_id AND x.generation = g.generation) AS assignment_count, CAST(0 AS BIGINT) AS offset_count FROM asks a LEFT JOIN groups g USING (group_id)""")
def describe_groups(spark, d):
    asks = _requests(spark, list(enumerate(DESCRIBED)), "pos int, group_id string")
    assigned = c.table(spark, d, "supplier").select(F.concat(F.lit("g"), F.col("s_nationkey").cast("string")).alias("group_id"), (F.col("s_suppkey") % 3).cast("int").alias("generation"))
    return catalog.describe_groups(asks, _groups(spark, d), _members(spark, d), assigned, offsets.current(_commits(spark, d)))


@query("""SELECT '__consumer_offsets' AS topic, CAST(range AS INT) AS "partition" FROM range(50) WHERE range NOT IN (SELECT p_size FROM part WHERE p_size % 3 = 0)""")
def internal_partitions_missing(spark, d):
    have = c.table(spark, d, "part").where("p_size % 3 = 0").select(F.lit("__consumer_offsets").alias("topic"), F.col("p_size").cast("int").alias("partition"))
    return catalog.missing_internal_partitions(spark, have)


COORDINATORS = [("a", 0), ("", 0), ("a", 1), ("b", 2), ("c", 9)]


@query("""WITH asks(key, key_type) AS (VALUES ('a', 0), ('', 0), ('a', 1), ('b', 2), ('c', 9)), x AS (SELECT *, CASE WHEN key = '' THEN 'invalid_request' WHEN key_type = 0 THEN 'none' WHEN key_type IN (1, 2) THEN 'coordinator_not_available' ELSE 'invalid_request' END AS error_code FROM asks)
SELECT *, CASE WHEN error_code = 'none' THEN 0 ELSE -1 END AS node_id FROM x""")
def find_coordinator(spark, d):
    return catalog.find_coordinator(_requests(spark, COORDINATORS, "key string, key_type int"))


# --- scalar functions


@query("""SELECT DISTINCT p_name, url_encode(p_name || '/~* +' || p_brand) AS escaped FROM part""")
def topic_key_escape(spark, d):
    return c.table(spark, d, "part").select("p_name", keys.escape_topic(F.concat("p_name", F.lit("/~* +"), "p_brand")).alias("escaped")).distinct()


@query("""SELECT DISTINCT url, CASE WHEN starts_with(k, 'pre/') THEN substr(k, 5) ELSE k END AS object_key FROM (SELECT 's3://box/pre/' || p_brand AS url, 'pre/' || p_brand AS k FROM part UNION ALL SELECT 'pre/' || p_brand, 'pre/' || p_brand FROM part UNION ALL SELECT 's3://other/' || p_brand, 'other/' || p_brand FROM part)""")
def object_key_normalize(spark, d):
    b = c.table(spark, d, "part").select("p_brand").distinct()
    url = F.explode(F.array(F.concat(F.lit("s3://box/pre/"), "p_brand"), F.concat(F.lit("pre/"), "p_brand"), F.concat(F.lit("s3://other/"), "p_brand"))).alias("url")
    return b.select(url).select("url", keys.normalize_object_key(F.col("url"), "box", "pre").alias("object_key"))


@query(f"""WITH own AS (SELECT c_custkey, hex(encode(c_name)) AS hx FROM customer), {murmur_sql("own", 50)} SELECT c_custkey, slot AS "partition" FROM hashed""")
def key_partitions(spark, d):
    return c.table(spark, d, "customer").select("c_custkey", partition_for_key(F.col("c_name").cast("binary"), 50).alias("partition"))


@query(f"""WITH {LOG} SELECT event_id, octet_length(encode(key)) + octet_length(encode(value)) + length(event_type) + octet_length(encode(event_type)) + 64 AS record_bytes FROM log""")
def record_size_estimate(spark, d):
    head = F.array(F.struct(F.col("event_type").alias("key"), F.col("event_type").cast("binary").alias("value")))
    return c.event_log(spark, d).select("event_id", keys.record_bytes(F.col("key").cast("binary"), F.col("value").cast("binary"), head).alias("record_bytes"))


@query(f'WITH {SEGMENTS} SELECT \'topics/events/\' || lpad(CAST("partition" AS VARCHAR), 10, \'0\') || \'/\' || lpad(CAST(base_offset AS VARCHAR), 20, \'0\') || \'-\' || lpad(CAST(last_offset AS VARCHAR), 20, \'0\') || \'-gen0.parquet\' AS object_key FROM segments')
def segment_object_keys(spark, d):
    s = c.event_segments(spark, d)
    return s.select(keys.segment_key(F.col("topic"), F.col("partition"), F.col("base_offset"), F.col("last_offset"), F.lit(0)).alias("object_key"))


def batch_bytes(batch_length, topic):
    """Estimate of a batch's size in a segment: its bytes, its topic's, and 20."""
    return batch_length + F.octet_length(topic) + 20


@query(f"WITH {BATCHES} SELECT topic, \"partition\", batch_no, bytes + octet_length(encode(topic)) + 20 AS estimate FROM batches")
def batch_size_estimate(spark, d):
    return c.event_batches(spark, d).select("topic", "partition", "batch_no", batch_bytes(F.col("bytes"), F.col("topic")).alias("estimate"))


# --- files and streams


def _records(spark, d):
    """The log as the fixed record relation."""
    head = F.array(F.struct(F.col("event_type").alias("key"), F.lit(None).cast("binary").alias("value")))
    return c.event_log(spark, d).select("topic", "partition", "offset", "timestamp_ms", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), head.alias("headers"))


def _told(records):
    return records.select("topic", "partition", "offset", "timestamp_ms", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.col("headers")[0]["key"].alias("header"))


TOLD = f'WITH {LOG} SELECT topic, "partition", "offset", timestamp_ms, key, value, event_type AS header FROM log'


@query(TOLD)
def wal1_roundtrip(spark, d):
    """Written as WAL files, indexed, and read again through the data source."""
    wal1.register(spark)
    folder = fresh_dir(spark, "wal")
    wal1.write_wal(_records(spark, d), folder, batch_records=100).write.parquet(f"{folder}-index")
    return _told(wal1.records_of(spark.read.format("wal1").load(folder)))


@query(TOLD.replace("FROM log", 'FROM log WHERE "partition" = 2 AND "offset" // 100 >= 1'))
def wal1_span_read(spark, d):
    """Only the batches that the index points at, each by its byte range."""
    folder = fresh_dir(spark, "wal")
    wal1.write_wal(_records(spark, d), folder, batch_records=100).write.parquet(f"{folder}-index")
    index = spark.read.parquet(f"{folder}-index").where("partition = 2 and last_offset >= 100")
    return _told(wal1.records_of(wal1.read_spans(index)))


@query(TOLD)
def parquet_segments_merge(spark, d):
    """Written as compacted segments in two runs, and merged into one."""
    own, folder = _records(spark, d), fresh_dir(spark, "segments")
    for half in (0, 1):
        compaction.write_segments(own.where(F.col("offset") % 2 == half), folder)
    compaction.merge_segments(spark, spark.read.parquet(folder).inputFiles(), f"{folder}-merged")
    return _told(spark.read.parquet(f"{folder}-merged").withColumn("partition", F.col("partition").cast("int")))


@query(f'WITH {LOG} SELECT topic, "partition", "offset", event_id FROM log')
def stream_ingest(spark, d):
    """The events as a stream: one micro-batch for each file, offsets going on from the index."""
    folder = fresh_dir(spark, "stream")
    e = c.table(spark, d, "events")
    came = spark.readStream.schema(e.schema).parquet(f"{d}/event[s].parquet")  # a pattern: a path must be a folder
    rows = came.select(F.lit("events").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), F.col("props").alias("value"), "event_id")
    ingest_stream.ingest(rows, folder, f"{folder}-checkpoint", order="event_id", segment_records=100).awaitTermination()
    return spark.read.parquet(f"{folder}/records").select("topic", "partition", "offset", "event_id")


@query(f"WITH {COMMITS} SELECT * FROM latest WHERE committed_offset IS NOT NULL")
def stream_offsets(spark, d):
    """The commits as a stream, folded into snapshots."""
    folder = fresh_dir(spark, "commits")
    _commits(spark, d).repartition(3).write.parquet(folder)
    came = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = group_stream.current_offsets(came, f"{folder}-out", f"{folder}-checkpoint")
    query.awaitTermination()
    last = query.lastProgress.batchId
    return spark.read.parquet(f"{folder}-out/snapshot={last}").where("committed_offset is not null")
