from pyspark.sql import functions as F

from sparklog.operators import compaction, groups, ingest, log, offsets, segments

T = 1735689600000


def rows(spark, topic, offsets_, start, step=1000):
    return spark.createDataFrame([(topic, 0, o, start + i * step) for i, o in enumerate(offsets_)], "topic string, partition int, offset bigint, timestamp_ms bigint")


def seeded(spark):
    """The tiers of four topics; the bounds of each."""
    wal = rows(spark, "mixed", range(10, 20), T + 20_000).union(rows(spark, "wal_only", range(15), T)).union(rows(spark, "wal_only", range(15, 30), T + 30_000))
    compacted = rows(spark, "mixed", range(20), T).union(rows(spark, "mixed", range(20, 40), T + 40_000)).union(rows(spark, "compacted_only", range(50), T))
    parts = spark.createDataFrame([("mixed", 0, 39, 0), ("compacted_only", 0, 49, 0), ("wal_only", 0, 29, 0), ("empty", 0, -1, 0)], "topic string, partition int, last_offset bigint, log_start_offset bigint")
    return wal, compacted, parts


def asked(spark, topic, at):
    return spark.createDataFrame([(0, topic, 0, at)], "pos int, topic string, partition int, at_ms bigint")


def test_list_offsets_facts(spark):
    wal, compacted, parts = seeded(spark)
    ends = {r["topic"]: r["offset"] for r in log.list_offsets(spark.createDataFrame([(i, t, 0, -1) for i, t in enumerate(("mixed", "compacted_only", "wal_only", "empty"))], "pos int, topic string, partition int, at_ms bigint"), parts).collect()}
    assert ends == {"mixed": 40, "compacted_only": 50, "wal_only": 30, "empty": 0}
    get = lambda own, topic, at: [(r["timestamp_ms"], r["offset"]) for r in log.list_offsets(asked(spark, topic, at), parts, own).collect()]
    assert get(compacted, "mixed", T + 5_000) == [(T + 5_000, 5)]
    assert get(compacted, "mixed", T + 30_000) == [(T + 40_000, 20)]
    assert get(compacted, "mixed", T + 3_600_000) == [(None, 40)]
    assert get(wal, "wal_only", T + 25_000) == [(T + 30_000, 15)]


def test_fetch_skips_holes_and_merges_tiers(spark):
    wal, compacted, _ = seeded(spark)
    own = rows(spark, "gap", [*range(10), *range(20, 30)], T)
    got = log.fetch(own, spark.createDataFrame([(0, "gap", 0, 12)], "pos int, topic string, partition int, start_offset bigint"))
    assert [r["offset"] for r in got.orderBy("offset").collect()] == list(range(20, 30))
    merged = log.merge_tiers(wal.where("topic = 'mixed'"), compacted.where("topic = 'mixed'")).orderBy("offset").collect()
    assert [r["offset"] for r in merged] == list(range(40))
    assert {r["offset"] for r in merged if r["tier"] == "wal"} == set(range(10, 20))


def test_first_batch_may_exceed_the_budget(spark):
    b = spark.createDataFrame([("t", 0, 0, 9, 100), ("t", 0, 10, 19, 50), ("t", 0, 20, 29, 50)], "topic string, partition int, base_offset bigint, last_offset bigint, bytes bigint")
    ask = lambda n: log.fetch_within_budget(b, spark.createDataFrame([(0, "t", 0, 0, n)], "pos int, topic string, partition int, start_offset bigint, max_bytes bigint")).count()
    assert (ask(1), ask(149), ask(150), ask(200)) == (1, 1, 2, 3)


def test_visibility_fact(spark):
    parts = spark.createDataFrame([("t", 0, 12, 2)], "topic string, partition int, last_offset bigint, log_start_offset bigint")
    s = spark.createDataFrame([("t", 0, "wal", 2, 9), ("t", 0, "topic_wal", 2, 12)], "topic string, partition int, tier string, base_offset bigint, last_offset bigint")
    r = segments.topic_offset_visibility(parts, s).first()
    assert (r["log_start_offset"], r["last_offset"], r["wal_count"], r["wal_min_offset"], r["wal_max_offset"], r["topic_wal_count"], r["topic_wal_min_offset"], r["topic_wal_max_offset"]) == (2, 12, 1, 2, 9, 1, 2, 12)


def test_constraints(spark):
    parts = spark.createDataFrame([("t", 0), ("t", 0)], "topic string, partition int")
    s = spark.createDataFrame([("t", 0, "wal", 0, 0, 9), ("t", 0, "wal", 1, 5, 12), ("u", 0, "wal", 0, 0, 1)], "topic string, partition int, tier string, segment_no bigint, base_offset bigint, last_offset bigint")
    assert {r["rule"]: r["n"] for r in segments.constraint_violations(s, parts).collect()} == {"partition listed twice": 1, "segments overlap": 1, "segment without partition": 1}


def test_duplicate_retry_keeps_its_offset(spark):
    s = "topic string, partition int, producer_id bigint, producer_epoch int, base_sequence bigint, last_sequence bigint, row_count bigint, arrival bigint"
    b = spark.createDataFrame([("t", 0, -1, -1, -1, -1, 9, 0), ("t", 0, 1, 0, 0, 0, 1, 1), ("t", 0, 1, 0, 0, 0, 1, 2), ("t", 0, 1, 0, 5, 6, 2, 3), ("t", 0, 1, 0, 1, 2, 2, 4)], s)
    got = [(r["outcome"], r["first_offset"]) for r in ingest.idempotent_append(b, order="arrival").orderBy("arrival").collect()]
    assert got == [("appended", 0), ("appended", 9), ("duplicate", 9), ("out_of_order_sequence_number", None), ("appended", 10)]


def test_offsets_are_gapless_in_blocks(spark):
    a = spark.range(1000).select(F.lit("t").alias("topic"), (F.col("id") % 3).cast("int").alias("partition"), F.col("id").alias("n"))
    whole, blocks = (ingest.assign_offsets(a, order="n", block_rows=k).orderBy("n").collect() for k in (10_000, 7))
    assert whole == blocks


def test_producer_ttl_fact(spark):
    s = spark.createDataFrame([(1, 0, None), (2, 10_790_000, None)], "producer_id bigint, last_seen_ms bigint, expires_at_ms bigint")
    assert [r["producer_id"] for r in ingest.live_sessions(s, 10_800_000, 60_000).collect()] == [2]


def test_bucket_facts(spark):
    s = "topic string, partition int, file_id bigint, min_offset bigint, bytes bigint, created_ms bigint"
    by_size = spark.createDataFrame([("t", 0, i, i, 100, 0) for i in range(3)], s)
    got = compaction.pick_buckets(by_size, target_bytes=200, least_files=2, most_files=3, now_ms=0, force_age_ms=1)
    assert sorted(r["file_id"] for r in got.collect()) == [0, 1]
    old = spark.createDataFrame([("t", 0, i, i, 50, 0) for i in range(5)], s)
    got = compaction.pick_buckets(old, target_bytes=10_000, least_files=3, most_files=4, now_ms=2_000_000, force_age_ms=1_000_000)
    assert sorted(r["file_id"] for r in got.collect()) == [0, 1, 2, 3]


def test_merge_fact(spark):
    s = "topic string, partition int, file_id bigint, min_offset bigint, max_offset bigint, bytes bigint, row_count bigint, min_timestamp bigint, max_timestamp bigint, generation int"
    r = compaction.merge_plan(spark.createDataFrame([("orders", 3, 1, 0, 4, 10, 5, 1, 2, 0), ("orders", 3, 2, 5, 9, 10, 5, 3, 4, 0)], s), 1_000).collect()
    assert [(x["min_offset"], x["max_offset"], x["generation"], x["parents"]) for x in r] == [(0, 9, 1, [1, 2])]


def test_vote_facts(spark):
    s = "group_id string, member_id string, name string, rank int"
    majority = [("g", "l", "range", 0), ("g", "l", "rr", 1), ("g", "a", "rr", 0), ("g", "a", "range", 1), ("g", "b", "rr", 0), ("g", "b", "range", 1)]
    tie = [("h", "a", "rr", 0), ("h", "a", "range", 1), ("h", "b", "range", 0), ("h", "b", "rr", 1)]
    none = [("i", "a", "x", 0), ("i", "b", "y", 0)]
    got = {r["group_id"]: r["protocol"] for r in groups.protocol_vote(spark.createDataFrame([*majority, *tie, *none], s)).collect()}
    assert got == {"g": "rr", "h": "range"}


def test_lag_facts(spark):
    parts = spark.createDataFrame([("t", 0, 50), ("t", 1, 35), ("u", 0, 120)], "topic string, partition int, last_offset bigint")
    committed = spark.createDataFrame([("g", "t", 0, 40), ("g", "u", 0, 100)], "group_id string, topic string, partition int, committed_offset bigint")
    known = spark.createDataFrame([("g",)], "group_id string")
    got = {(r["topic"], r["partition"]): r["lag"] for r in offsets.lag(committed, parts, known).collect()}
    assert got == {("t", 0): 11, ("t", 1): None, ("u", 0): 21}


def test_changelog_codec(spark):
    from sparklog.functions import keys

    e = spark.createDataFrame([("g", "t", 3, 7, "m", 99, 0), ("g", "t", 3, 2**40, None, -1, 1), ("g", "t", 3, None, None, None, 2)], "group_id string, topic string, partition int, committed_offset bigint, metadata string, commit_ms bigint, seq bigint")
    out = offsets.encode_changelog(e).withColumn("back", keys.decode_offset_value(F.col("value_bytes"))).orderBy("seq").collect()
    assert bytes(out[0]["key_bytes"]) == b"\x00\x01\x00\x01g\x00\x01t\x00\x00\x00\x03"
    assert [r["back"] and tuple(r["back"]) for r in out] == [(7, "m", 99), (2**40, None, -1), None]
    assert [r["log_offset"] for r in out] == [0, 1, 2]


def test_pruning_reaches_parquet(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    own = rows(spark, "t", range(1000), T).withColumn("key", F.lit(b"k")).withColumn("value", F.col("offset").cast("string").cast("binary"))
    compaction.write_segments(own, path)
    read = spark.read.parquet(path)
    plan = read.where("topic = 't' and partition = 0 and offset >= 900").select("offset")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(offset), GreaterThanOrEqual(offset,900)]" in plan and "ReadSchema: struct<offset:bigint>" in plan and "topic" in plan.split("PartitionFilters: ")[1].split("]")[0]
    files = [f for f in read.inputFiles()]
    compaction.merge_segments(spark, files, f"file://{tmp_path}/merged")
    assert spark.read.parquet(f"file://{tmp_path}/merged").count() == 1000
