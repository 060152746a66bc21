import os
import random
import time

import pytest
from pyspark.sql import functions as F

from sparklog.llm import hubs, near_dup
from sparklog.llm.components import components
from sparklog.llm.scratch import Scratch

SCHEMA = "doc_id bigint, text string"


def brute(rows, k, percent=80):
    """Sets and component names by comparing every pair."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                up[root(i)] = root(j)
    names = {}
    for i, (doc_id, _) in enumerate(rows):
        names[root(i)] = min(names.get(root(i), doc_id), doc_id)
    return sorted((d, len(sets[i]), names[root(i)], d == names[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, groups=12, copies=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 20, 80, 200]))]
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.randint(0, len(own) // 18)):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("k", [4, 5])
def test_same_as_brute_force(spark, k):
    rows = corpus(k) + [(900, None), (901, ""), (902, " \n "), (903, "One two"), (904, "one  TWO"), (905, "É été"), (906, "é été")]
    got = sorted(tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=k).collect())
    assert got == brute(rows, k)


def test_large_groups_of_near_copies_in_several_components(spark):
    """Copies of one base so far apart that pivots don't link them all; components meet in blocks."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(260):
        own = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            own[rng.randrange(150)] = f"x{rng.random()}"
        rows.append((i, " ".join(own)))
    got = sorted(tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=4).collect())
    assert got == brute(rows, 4)


def test_odd_rows(spark):
    odd = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, None), (7, "z " * 30_000)], SCHEMA)
    odd = odd.select("*", F.lit("x").alias("node"), F.lit(1).alias("sig"), F.lit(None).alias("key"))
    got = sorted((tuple(r) for r in near_dup.near_duplicates(odd).collect()), key=str)
    assert got == sorted([(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (None, 0, None, True), (7, 1, 7, True)], key=str)
    kept = near_dup.deduplicate(odd.where("doc_id is not null"))
    assert kept.columns == ["doc_id", "text", "node", "sig", "key"] and kept.count() == 2
    assert near_dup.near_duplicates(odd.limit(0)).count() == 0


def test_rows_are_judged_one_by_one(spark):
    """Repeated and null ids, in every combination; the least id of a component keeps one row."""
    text, other = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, text), (2, text.upper()), (None, text), (None, text), (3, other), (3, other), (3, text), (None, "z y x w v u"), (4, None), (4, None), (None, ""), (9, other.upper())]
    d = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("x").alias("row"), F.lit(1).alias("digest"), F.lit(2).alias("row_1"), F.lit(None).cast("string").alias("names"))
    got = near_dup.deduplicate(d)
    want = [(1, text), (3, other), (None, "z y x w v u"), (4, None), (4, None), (None, "")]
    assert got.columns == d.columns and sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, want))
    assert near_dup.deduplicate(d.limit(0)).count() == 0
    strings = d.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    assert near_dup.deduplicate(strings).count() == len(want)


def test_crowded_buckets_against_brute_force(spark, monkeypatch):
    """Several components in buckets of any size, met in blocks as in pairs."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(150):
        own = list(base)
        for at in rng.sample(range(90), rng.choice([0, 1, 2, 3, 6])):
            own[at] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(own)))
    want = brute(rows, 4)
    for few, block in ((2, 7), (1_000_000, 200)):
        monkeypatch.setattr(hubs, "FEW_ROWS", few)
        monkeypatch.setattr(near_dup, "FEW", few)
        monkeypatch.setattr(near_dup, "BLOCK", block)
        assert sorted(tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle=4).collect()) == want


def test_components_of_hubs(spark, monkeypatch):
    monkeypatch.setattr(hubs, "FEW_ROWS", 10)
    edges = spark.range(1, 3000).select(F.lit(5_000).cast("long").alias("a"), F.col("id").alias("b"))
    got = components(edges, Scratch(spark)).collect()
    assert len(got) == 3000 and {r["root"] for r in got} == {1}
    assert components(edges.limit(0), Scratch(spark)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (100, 101)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(edges, Scratch(spark)).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_pigeonhole_keys_meet(spark):
    """Signatures within the distance share a key, whatever positions differ."""
    rng = random.Random(1)
    rows = []
    for i in range(60):
        a = [p << 16 | rng.randrange(1 << 16) for p in range(64)]
        b = list(a)
        for p in rng.sample(range(64), 27):
            b[p] = p << 16 | rng.randrange(1 << 16)
        rows.append((i, a, b))
    df = spark.createDataFrame(rows, "i int, a array<int>, b array<int>")
    met = df.where(F.arrays_overlap(near_dup.bucket_keys(F.col("a"), 64, 14, 1), near_dup.bucket_keys(F.col("b"), 64, 14, 1)))
    assert met.count() == 60


def test_scratch_leaves_no_shuffle_files(spark):
    """A saved table's shuffle files go with its execution, not with the driver's garbage."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before, setting = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    rows = spark.range(10_000).withColumn("k", F.col("id") % 100)
    saved, seen = Scratch(spark).measured(rows.join(rows.groupBy("k").count().hint("merge"), "k").repartition("id"), "t", n=F.count(F.lit(1)))
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and seen == {"n": 10_000} and saved.count() == 10_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_deduplicate_leaves_only_what_its_result_reads(spark, monkeypatch):
    """Signatures, sets and links are gone before the result, which shuffles whole texts, is read."""
    rng = random.Random(8)
    rows = []
    for i in range(60):
        own = [f"w{j}" for j in range(90)]
        for at in rng.sample(range(90), rng.choice([0, 1, 2, 3, 6])):
            own[at] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(near_dup, "FEW", 2)
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    made, inner = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, *a, **b: made.append(inner(self, *a, **b)) or made[-1])
    got = near_dup.deduplicate(spark.createDataFrame(rows, SCHEMA))
    names = [os.path.basename(t.scratch_path).split("-")[0] for t in made]
    left = [n for n, t in zip(names, made, strict=True) if os.path.exists(t.scratch_path.removeprefix("file:"))]
    assert {"sig", "shared", "sets", "open", "links"} <= set(names) and left == ["kept"]
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({c for _, _, c, _ in brute(rows, 5)})
