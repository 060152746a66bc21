from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparklog.llm import hubs, mixing, sharding
from sparklog.llm.scratch import Scratch

SCHEMA = "doc_id bigint, text string, source string"


def targets(sizes, weights=(5, 2, 1), most=3.0):
    """Shares by weight; what a full source can't take is shared again among the others, round after round."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, full, left = {}, set(), float(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s], left = most * sizes[s], left - most * sizes[s]
            full.add(s)


def docs(spark, n=600):
    rows = [(i, "w " * (i * 7 % 40), None if i % 11 == 0 else f"s{min(i % 13, 5)}") for i in range(n)] + [(n, None, "s1"), (None, "a b", "s1"), (3, "w " * 21, "s3"), (n + 1, "y " * 20_000, "s0"), (n + 2, "", "empty")]
    return spark.createDataFrame(rows, SCHEMA)


def test_targets_and_epochs(spark):
    d = docs(spark)
    got = mixing.mix(d.withColumn("size", F.lit("x")).withColumn("block", F.lit(1)), keep=["source"]).collect()
    assert len(got) == d.count()
    size, taken = Counter(), Counter()
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = targets(dict(size))
    for r in got:
        whole = int(r["target"] // r["source_size"]) if r["source_size"] else 0
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert whole * r["size"] <= r["taken"] <= min(3, whole + 1) * r["size"]
    assert all(taken[s] == round(want[s]) for s in size)
    again = mixing.mix(d.repartition(7), keep=["source"]).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


@pytest.mark.parametrize("many", [False, True])
def test_each_document_against_brute_force(spark, monkeypatch, many):
    """Documents of a source in the order of their keys take what is left of its target, one after another."""
    if many:
        monkeypatch.setattr(hubs, "FEW_ROWS", 10)
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    d = docs(spark, 400)
    keys = d.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.exponential_key(F.col("doc_id"), F.col("text"), mixing.text_weight(F.col("text")), 8).alias("key")).collect()
    size = Counter()
    for r in keys:
        size[r["source"]] += r["size"]
    left, want = {}, Counter()
    aims = targets(dict(size))
    for r in sorted(keys, key=lambda r: (r["key"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"])):
        s = r["source"]
        epochs = int(aims[s] // size[s]) if size[s] else 0
        rest = left.setdefault(s, round(aims[s]) - epochs * size[s])
        part = max(0, min(r["size"], rest))
        left[s] = rest - part
        want[(r["doc_id"], r["size"], epochs * r["size"] + part)] += 1
    got = Counter((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(d).collect())
    assert got == want


def test_blocks_are_not_overfull_at_any_weight(spark):
    for weight in (1.0, 0.1, 0.003):
        key = mixing.exponential_key(F.col("id"), F.lit("a"), F.lit(weight), 8)
        most = spark.range(200_000).select(mixing.block_of(key, F.lit(50)).alias("b")).groupBy("b").count().agg(F.max("count")).first()[0]
        assert most < 200_000 / 50


def test_water_level_with_full_sources(spark):
    sizes = {"a": 10, "b": 1000, "c": 3, "d": 50, None: 7}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(targets(sizes)) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mixed_rows_keep_their_columns(spark):
    d = docs(spark).withColumn("copies", F.lit("mine"))
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns
    assert mixing.mix(d.limit(0)).count() == 0


def test_heavier_documents_come_first(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "good words here ok").otherwise("# $ % &").alias("text"), F.when(F.col("id") < 2000, "a").otherwise("c").alias("source"))
    got = mixing.mix(d, weights=(1, 9), keep=["text"]).where("doc_id < 2000").groupBy("text").agg(F.sum("taken").alias("n")).collect()
    n = {r["text"]: r["n"] for r in got}
    assert n["good words here ok"] > 1.7 * n["# $ % &"]


def test_mix_is_native(spark):
    plan = mixing.mix(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("big", [0, 30, 400])
def test_shards(spark, monkeypatch, big):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 10)
    rows = [(i, f"text {i % 250}" if i % 3 else f"own {i}") for i in range(500)] + [(1000 + i, "same") for i in range(big)] + [(None, None), (7, ""), (7, ""), (8, None), (9, "é" * 100_000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("shard", F.lit("mine")).withColumn("h1", F.lit(0))
    got = sharding.shard_documents(d).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len((t or "").encode()) + 1) for i, t in rows)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    where = {}
    for r in got:
        where.setdefault((r["text_crc32"], r["size"]), []).append(r["shard"])
    apart = [g for k, g in where.items() if 1 < len(g) <= 10 and k[1] > 1 and len(set(g)) > 1]
    assert len(apart) <= (3 if big < 400 else 12)
    if big:
        own = next(g for g in where.values() if len(g) == big)
        fullest = sum(n for _, n in Counter(own).most_common(-(-big // min(sizes.values()))))
        assert fullest >= 0.8 * big
    again = sharding.shard_documents(d.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_large_groups_fill_shards_of_their_own(spark):
    rows = [(i, "one") for i in range(400)] + [(1000 + i, "two") for i in range(410)] + [(2000 + i, f"text {i % 200}") for i in range(600)] + [(3000 + i, f"own {i}") for i in range(190)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
    where = {}
    text = dict(rows)
    for r in got:
        where.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert len(where["one"]) == 4 and len(where["two"]) <= 5  # shards hold 100
    assert sum(len(s) > 1 for t, s in where.items() if t.startswith("text")) <= 15


def test_few_groups_are_cut_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 20)  # about ten blocks a shard
    rows = [(i, f"text {i // 3}") for i in range(3000)] + [(4000 + i, "big") for i in range(170)] + [(5000 + i, f"own {i}") for i in range(10)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), rounds=1).collect()
    sizes, text, where = Counter(r["shard"] for r in got), dict(rows), {}
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    for r in got:
        where.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert len(where["big"]) == 1 and sum(len(s) > 1 for s in where.values()) <= 15


def test_parts_fit_the_room():
    room = [10, 10, 9, 9]
    assert sharding.parts_of([21, 12], room) == [[(0, 9, 0), (10, 19, 1), (20, 20, 2)], [(0, 8, 3), (9, 11, 2)]]
    assert room == [0, 0, 5, 0]


def test_few_and_no_rows(spark):
    d = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id bigint, text string")
    assert sharding.shard_documents(d).count() == 2
    assert sharding.shard_documents(d.limit(0)).count() == 0


def test_rounds_of_propagation_join_nothing(spark, monkeypatch):
    """Each join's plan and table is a piece of the driver's memory."""
    plans, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name="t": (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), save(self, df, name))[1])
    docs = spark.createDataFrame([(i, f"text {i // 2}") for i in range(400)], "doc_id long, text string")
    rows = sharding.shard_documents(docs, shards=4).collect()
    rounds = [plan for name, plan in plans if name in ("cells", "groups")]
    assert len(rounds) > 1 and not any("Join" in plan for plan in rounds)
    assert sorted(r["doc_id"] for r in rows) == list(range(400)) and {sum(r["shard"] == s for r in rows) for s in range(4)} == {100}
