import pyarrow as pa
from pyspark.sql import functions as F

from sparklog.schema import RECORD
from sparklog.sources import wal1


def made(spark):
    rows = [(t, p, o, 1735689600000 + o * 1000, f"k-{o}".encode(), f"msg-{o}".encode(), [{"key": "h", "value": b"1"}] if o % 2 else None) for t in ("a", "b") for p in (0, 1) for o in range(25)]
    return spark.createDataFrame(rows, RECORD)


def test_write_read_spans_and_stream(spark, tmp_path):
    folder = f"file://{tmp_path}/wal"
    wal1.register(spark)
    index = spark.createDataFrame(wal1.write_wal(made(spark), folder, batch_records=10).collect(), wal1.INDEX)
    assert index.count() == 12
    batches = spark.read.format("wal1").load(folder)
    key = ["topic", "partition", "offset"]
    want = made(spark).orderBy(*key).collect()
    assert wal1.records_of(batches).orderBy(*key).collect() == want
    assert wal1.records_of(batches.where("topic = 'a' and partition = 1")).count() == 25
    spans = wal1.read_spans(index.where("topic = 'b' and last_offset >= 20"))
    assert sorted({r["offset"] for r in wal1.records_of(spans).collect()}) == list(range(20, 25))
    q = spark.readStream.format("wal1").load(folder).select("topic", "partition", F.size("records").alias("n")).writeStream.format("memory").queryName("wal").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from wal").first()[0] == 100


def test_stream_takes_each_file_once_whatever_its_name(spark, tmp_path):
    """Between two triggers files come whose names sort before those that were read."""
    folder, names = tmp_path / "wal", iter(["m", "z", "a", "n", "0"])
    wal1.register(spark)
    folder.mkdir()

    def arrive(topic):
        wal1.write_wal(made(spark).where(f"topic = '{topic}' and partition = 0"), f"file://{tmp_path}/new-{topic}").collect()
        for file in (tmp_path / f"new-{topic}").glob("*.wal"):
            file.rename(folder / f"{next(names)}.wal")

    def trigger():
        read = spark.readStream.format("wal1").load(f"file://{folder}").select("topic", F.size("records").alias("n"))
        q = read.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return {r["topic"]: r["n"] for r in spark.read.schema("topic string, n int").parquet(str(tmp_path / "out")).groupBy("topic").agg(F.sum("n").alias("n")).collect()}

    arrive("b")
    next(names)
    assert trigger() == {"b": 25}
    arrive("a")
    assert trigger() == {"a": 25, "b": 25} and trigger() == {"a": 25, "b": 25}


def test_a_task_gives_rows_by_their_records_and_not_by_their_number(spark, tmp_path, monkeypatch):
    """Batches of 1000 records: ten of them leave a reader, whether they come of a file or an index."""
    rows = spark.range(40_000).selectExpr("'a' as topic", "0 as partition", "id as offset", "id + 1 as timestamp_ms", "cast(id as string) as k", "repeat('v', 20) as v")
    rows = rows.selectExpr("topic", "partition", "offset", "timestamp_ms", "cast(k as binary) as key", "cast(v as binary) as value", "cast(null as array<struct<key:string,value:binary>>) as headers")
    folder = f"file://{tmp_path}/wal"
    index = wal1.write_wal(rows, folder, batch_records=1_000).collect()
    assert [r["row_count"] for r in index] == [1_000] * 40
    reader = wal1.WalReader({"path": folder})
    (file,) = reader.partitions()
    assert [sum(map(len, b.column("records").to_pylist())) for b in reader.read(file)] == [wal1.FLUSH_RECORDS] * 4
    spans = wal1.read_spans(spark.createDataFrame(index, wal1.INDEX).coalesce(1))
    assert wal1.records_of(spans).where("cast(offset as string) = cast(key as string) and timestamp_ms = offset + 1").count() == 40_000


def test_the_index_of_many_files_of_one_task(spark, tmp_path):
    """The rows of the index leave with their file."""
    folder = f"file://{tmp_path}/wal"
    index = wal1.write_wal(made(spark), folder, batch_records=5, file_bytes=1).collect()
    assert len(index) == 20 and len({r["path"] for r in index}) == 20
    spans = wal1.records_of(wal1.read_spans(spark.createDataFrame(index, wal1.INDEX)))
    key = ["topic", "partition", "offset"]
    assert spans.orderBy(*key).collect() == made(spark).orderBy(*key).collect()
