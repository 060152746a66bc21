from pyspark.sql import functions as F

from sparklog.streaming import groups, ingest

ARRIVALS = "topic string, partition int, timestamp_ms bigint, value string, n bigint"
BATCHES = "producer_id bigint, producer_epoch int, topic string, partition int, base_sequence bigint, last_sequence bigint, arrival bigint"


def files(spark, rows, schema, folder):
    """One file, and so one micro-batch, for each list of rows."""
    for i, r in enumerate(rows):
        spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_offsets_go_on_across_micro_batches(spark, tmp_path):
    came = files(spark, [[("t", 0, 1, "a", 0), ("t", 1, 1, "b", 1)], [("t", 0, 2, "c", 2), ("t", 0, 3, "d", 3)]], ARRIVALS, f"{tmp_path}/in")
    q = ingest.ingest(came, f"{tmp_path}/log", f"{tmp_path}/ck", order="n", segment_records=100)
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/log/records").orderBy("n").select("partition", "offset").collect()
    assert [tuple(r) for r in got] == [(0, 0), (1, 0), (0, 1), (0, 2)]
    assert spark.read.parquet(f"{tmp_path}/log/index").agg(F.sum("row_count")).first()[0] == 4


def test_sequence_gate(spark, tmp_path):
    ingest.use_rocksdb(spark)
    came = files(spark, [[(1, 0, "t", 0, 0, 1, 0)], [(1, 0, "t", 0, 0, 1, 1), (1, 0, "t", 0, 5, 6, 2), (1, 0, "t", 0, 2, 2, 3), (2, 0, "t", 0, 7, 7, 4)]], BATCHES, f"{tmp_path}/in")
    q = ingest.sequence_gate(came).writeStream.format("memory").queryName("gate").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = [r["outcome"] for r in spark.sql("select * from gate order by arrival").collect()]
    assert got == ["appended", "duplicate", "out_of_order_sequence_number", "appended", "out_of_order_sequence_number"]


def test_current_offsets(spark, tmp_path):
    s = "group_id string, topic string, partition int, log_offset bigint, committed_offset bigint"
    came = files(spark, [[("g", "t", 0, 0, 5), ("g", "t", 1, 1, 6)], [("g", "t", 0, 2, 9), ("g", "t", 1, 3, None)]], s, f"{tmp_path}/in")
    q = groups.current_offsets(came, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(120)
    got = {r["partition"]: r["committed_offset"] for r in spark.read.parquet(f"{tmp_path}/out/snapshot=1").collect()}
    assert got == {0: 9, 1: None}


def test_members_expire(spark, tmp_path):
    ingest.use_rocksdb(spark)
    s = "group_id string, member_id string, heartbeat_ms bigint, session_timeout_ms bigint"
    came = files(spark, [[("g", "a", 1_000, 500), ("g", "b", 1_000, 500)], [("g", "b", 9_000, 500)], [("g", "c", 9_100, 500)]], s, f"{tmp_path}/in")
    beats = came.withColumn("at", F.timestamp_millis("heartbeat_ms"))
    q = groups.expirations(beats).writeStream.format("memory").queryName("gone").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert ("a", 1_501) in {(r["member_id"], r["expired_ms"]) for r in spark.sql("select * from gone").collect()}
