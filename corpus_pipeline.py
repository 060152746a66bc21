"""From raw documents to training shards: each stage applies one operator to all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparklog.llm import decontaminate, mixing, near_dup, quality, sharding
from sparklog.llm.scratch import Scratch


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: those that score below 0.7.

    Null, empty and blank texts score 0. Long texts are scored whole. Rows are judged by their texts alone, so that
    repeated rows and null ids stay or go like any others. Empty tables give no rows. All columns stay as they are.
    """
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, a similarity of 0.8 or more.

    It is that with the least id, an id before none; of repeated rows one stays. Null and blank texts are linked with
    nothing and stay. Long texts are compared whole. Empty tables give no rows. All columns stay as they are.
    """
    return near_dup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Null and empty texts stay, on either side they match nothing. Long texts are searched whole. Rows are judged by
    their texts alone, repeated ones alike. Empty tables give no rows. All columns stay as they are.
    """
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document taken twice gives two rows.

    Documents without words are never taken. Null sources are a source of their own. Equal rows draw equal keys and
    are taken one after another. Empty tables give no rows. All columns stay as they are.
    """
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal texts meet in one of 16 shards whose sizes differ by one row at most.

    Each row, repeated ones too, gets a shard and a slot. Null texts are linked with nothing. Empty tables give no
    rows. The columns of ``sharding.shard_documents`` are returned; others of ``docs`` are ignored.
    """
    return sharding.shard_documents(docs)


STAGES = [("quality", classify_quality), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("sharding", shard)]
#: The classifier and the sampling have no form in SQL; each stage is tested against a plain version of its rule.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
