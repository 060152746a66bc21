import pytest
from pyspark.sql import functions as F

from sparklog.functions import keys
from sparklog.operators import catalog, groups, ingest, offsets

NOW = 100_000
OFFERED = [(0, "range", bytearray(b"m"))]
ASKS = "pos int, group_id string, member_id string, instance_id string, protocol_type string, session_timeout_ms int, rebalance_timeout_ms int, version int, protocols array<struct<rank:int,name:string,metadata:binary>>"
GROUPS = "group_id string, generation int, state string, protocol_type string, protocol string, leader_member_id string, sync_deadline_ms bigint, join_deadline_ms bigint"
MEMBERS = "group_id string, member_id string, instance_id string, session_timeout_ms int, rebalance_timeout_ms int, last_heartbeat_ms bigint, join_generation int, member_generation int, assigned boolean"


def member(spark, *rows):
    known = spark.createDataFrame([("g", m, i, 6_000, 30_000, at, j, 3, True) for m, i, at, j in rows], MEMBERS)
    offered = F.array(F.struct(F.lit(0).alias("rank"), F.lit("range").alias("name"), F.lit("m").cast("binary").alias("metadata")))
    return known.withColumn("protocols_hash", keys.protocol_digest(offered))


def group(spark, state="Stable", deadline=None, leader="g:i"):
    return spark.createDataFrame([("g", 3, state, "consumer", "range", leader, None, deadline)], GROUPS)


def joined(spark, g, m, *asks):
    rows = [(i, a.get("group", "g"), a.get("member", ""), a.get("instance"), a.get("type", "consumer"), a.get("session", 6_000), a.get("rebalance", 30_000), a.get("version", 3), a.get("protocols", OFFERED)) for i, a in enumerate(asks)]
    return groups.join_check(spark.createDataFrame(rows, ASKS), g, m, NOW).orderBy("pos").collect()


def test_joins(spark):
    m = member(spark, ("g:i", "i", NOW, 3), ("b", None, NOW, 3))
    got = joined(
        spark, group(spark), m, {"instance": "i"}, {"member": "nobody"}, {"protocols": []}, {"type": "connect"}, {"session": 1}, {"rebalance": 6_000, "session": 7_000}, {"version": 4},
        {"member": "g:i", "instance": "i"}, {"member": "b"}, {"member": "g:i", "instance": "i", "protocols": [(0, "range", bytearray(b"n"))]}, {"group": "new"}, {"member": "b", "session": 0, "rebalance": 0}, {"group": ""},
    )
    assert [r["error_code"] for r in got] == [
        "fenced_instance_id", "unknown_member_id", "inconsistent_group_protocol", "inconsistent_group_protocol", "invalid_session_timeout", "invalid_session_timeout", "member_id_required",
        "none", "none", "none", "none", "none", "invalid_group_id",
    ]
    assert [r["pos"] for r in got if r["skip_assignment"]] == [7]
    assert [r["state"] for r in got][7:12] == ["Stable", *["PreparingRebalance"] * 4]
    assert got[9]["protocols_changed"] and not got[8]["protocols_changed"] and not got[11]["timeouts_changed"]
    assert got[6]["assigned_member_id"].startswith("member-") and got[6] == joined(spark, group(spark), m, *[{}] * 6, {"version": 4})[6]


def test_an_expired_static_member_is_not_fenced(spark):
    r = joined(spark, group(spark), member(spark, ("g:i", "i", 0, 3)), {"instance": "i"})[0]
    assert (r["error_code"], r["assigned_member_id"], r["is_new"]) == ("none", "g:i", False)


LISTED = "group_id string, member_id string, name string, rank int"


@pytest.mark.parametrize(
    ("rows", "deadline", "names", "want"),
    [
        ([("a", None, NOW, 4), ("b", None, NOW, 4)], None, {"a": "range", "b": "range"}, ("completing", 4, "CompletingRebalance", "a", 2)),
        ([("a", None, NOW, 4), ("b", None, NOW, 3)], None, {"a": "range", "b": "range"}, ("waiting", 3, "PreparingRebalance", "z", 2)),
        ([("a", None, NOW, 4), ("b", None, NOW, 3)], NOW, {"a": "range", "b": "range"}, ("completing", 4, "CompletingRebalance", "a", 1)),
        ([("a", None, NOW, 4), ("b", None, NOW, 4)], None, {"a": "range", "b": "sticky"}, ("inconsistent_group_protocol", 3, "PreparingRebalance", "z", 2)),
        ([("a", None, 0, 4)], None, {"a": "range"}, ("empty", 3, "Empty", None, 0)),
        ([("a", None, NOW, 3)], NOW, {"a": "range"}, ("empty", 3, "Empty", None, 0)),
        ([], None, {}, ("empty", 3, "Empty", None, 0)),
    ],
)
def test_rebalance_tick(spark, rows, deadline, names, want):
    listed = spark.createDataFrame([("g", m, n, 0) for m, n in names.items()], LISTED)
    r = groups.rebalance_tick(group(spark, "PreparingRebalance", deadline, leader="z"), member(spark, *rows), listed, NOW).first()
    assert (r["outcome"], r["generation"], r["state"], r["leader_member_id"], r["members"]) == want
    assert r["sync_deadline_ms"] == (NOW + 30_000 if want[0] == "completing" else None)


def test_commits(spark):
    s = "pos int, group_id string, member_id string, generation int, topic string, partition int"
    asks = spark.createDataFrame([(0, "g", "a", 3, "t", 0), (1, "g", "a", 2, "t", 0), (2, "g", "x", 3, "t", 0), (3, "g", "", 3, "t", 0), (4, "g", "a", None, "t", 0), (5, "h", "", -1, "t", 0)], s)
    codes = lambda g, m: [r["error_code"] for r in offsets.commit_check(asks, g, m, NOW).orderBy("pos").collect()]
    well = member(spark, ("a", None, NOW, 3))
    assert codes(group(spark), well) == ["none", "illegal_generation", "unknown_member_id", "none", "none", "group_id_not_found"]
    assert codes(group(spark, "PreparingRebalance"), well)[0] == "rebalance_in_progress"
    assert codes(group(spark), member(spark, ("a", None, NOW, 3), ("b", None, 0, 3)))[0] == "rebalance_in_progress"
    late = group(spark, "CompletingRebalance").withColumn("sync_deadline_ms", F.lit(NOW - 1))
    assert codes(late, well) == ["rebalance_in_progress"] * 5 + ["group_id_not_found"]


def test_pages_have_bounds(spark):
    none = spark.createDataFrame([], "topic string, partition int")
    for limit, offset in ((0, 0), (1_001, 0), (1, -1)):
        with pytest.raises(ValueError):
            catalog.list_topics(none.select("topic"), none, limit, offset)


def test_retries_are_known_for_a_while(spark):
    s = "topic string, partition int, producer_id bigint, producer_epoch int, base_sequence bigint, last_sequence bigint, row_count bigint, arrival bigint, at bigint"
    sent = [("t", 0, 1, 0, i, i, 1, i, i * 10) for i in range(4)]
    again = lambda base, at: ("t", 0, 1, 0, base, base, 1, 10, at)
    told = lambda base, at, **k: ingest.idempotent_append(spark.createDataFrame([*sent, again(base, at)], s), order="arrival", **k).where("arrival = 10").first()["outcome"]
    assert told(2, 40, keep=2) == "duplicate" and told(1, 40, keep=2) == "out_of_order_sequence_number"
    assert told(1, 40, at_ms="at", ttl_ms=30) == "duplicate" and told(1, 41, at_ms="at", ttl_ms=30) == "out_of_order_sequence_number"


def test_batches_and_ids_are_numbered_alike_in_blocks(spark):
    b = spark.range(500).select(F.lit("t").alias("topic"), (F.col("id") % 3).cast("int").alias("partition"), F.col("id").alias("n"), (F.col("id") % 4).alias("row_count"))
    ends = spark.createDataFrame([("t", i, 10 * i) for i in range(3)], "topic string, partition int, last_offset bigint")
    whole, blocks = (ingest.assign_batch_offsets(b, ends, order="n", block_rows=k).orderBy("n").select("n", "base_offset", "last_offset").collect() for k in (10_000, 7))
    assert whole == blocks
