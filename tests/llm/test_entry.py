import re
from collections import Counter

import corpus_pipeline

import __spark_entry__
from sparklog.llm import decontaminate, near_dup, quality

SF = "/root/testdata/sf0.001"


def test_ten_operators_and_the_pipeline():
    names = __spark_entry__.queries()
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 11)) and "pipeline" in names


def test_pipeline_stages(spark):
    """Each stage judged on its own input, by the plain form of its rule."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    good = steps["quality"](spark, docs, SF).cache()
    score = {r["doc_id"] for r in quality.score_documents(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in good.collect()} == score and good.columns == docs.columns
    single = steps["near_dedup"](spark, good, SF).cache()
    kept = {r["doc_id"] for r in near_dup.near_duplicates(good, shingle=5).where("kept").collect()}
    assert {r["doc_id"] for r in single.collect()} == kept and single.columns == docs.columns
    clean = steps["decontamination"](spark, single, SF).cache()
    own = decontaminate.Matcher([(r["item_id"], r["text"]) for r in bench.collect()], 0.2, 5)
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect() if not own.matches(r["text"])}
    mixed = steps["mixing"](spark, clean, SF).cache()
    assert mixed.columns == docs.columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3
    shards = steps["sharding"](spark, mixed, SF).collect()
    assert Counter(r["doc_id"] for r in shards) == Counter(r["doc_id"] for r in mixed.collect())
    sizes = Counter(r["shard"] for r in shards).values()
    assert max(sizes) - min(sizes) <= 1
