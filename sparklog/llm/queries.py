"""The ``opN_`` queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, mixing, near_dup, pii, quality, search, sharding, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, read = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


OP1_SQL = """
WITH said AS (SELECT page_id, coalesce(html, '') AS html FROM pages), sized AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM said
), firsts AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM sized)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM firsts"""


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = chat.format_records(chat.conversation_records(rows.unionByName(own)))
    text, spans = F.col("formatted"), F.col("loss_spans")
    read = out.select("conv_id", chat.parsed(text).alias("turns"), chat.under_mask(text, spans).alias("masked"), F.length(text).cast("long").alias("formatted_chars"))
    said_all = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said_all, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), "formatted_chars",
    )


_ESC = "replace(replace(replace({}, '\\', '\\\\'), '<turn', '<\\turn'), '</turn', '<\\/turn')"
OP2_SQL = f"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), said AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said_all,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS masked,
    sum(16 + length(replace({_ESC.format('role')}, '>', '\\>')) + length({_ESC.format('text')})) AS formatted_chars
  FROM every GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said_all) AS turns_sha256, CAST(length(masked) AS BIGINT) AS loss_chars,
  sha256(masked) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM said"""


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, similarity=0.8)


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words
), flat AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * same >= 80 * (len(x.s) + len(y.s) - same)
), two AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reach.doc_id, two.b FROM reach JOIN two ON two.a = reach.r),
named AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN named USING (doc_id)"""


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, sf_dir, "documents"))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=16)


def op7_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_table(spark, sf_dir, "documents"), F.col("doc_id") % 20 == 0, k=10)


OP7_SQL = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
tf AS (SELECT doc_id, w, count(*) AS tf FROM words GROUP BY ALL), lengths AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id),
stats AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT sum(n) FROM lengths) / (SELECT count(*) FROM documents) AS mean),
idf AS (SELECT w, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, stats GROUP BY w, docs),
scored AS (SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.tf * idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score
  FROM tf q JOIN tf d ON q.w = d.w JOIN idf ON idf.w = d.w JOIN lengths l ON l.doc_id = d.doc_id, stats WHERE q.doc_id % 20 = 0 GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored WHERE score > 0)
SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("copies")


def op3_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_quality_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    "op1_warc_normalise": op1_warc_normalise,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_toxicity_lexicon": op3_toxicity_lexicon,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_personal_data": op5_personal_data,
    "op6_sharding": op6_sharding,
    "op7_bm25_search": op7_bm25_search,
    "op8_source_mixing": op8_source_mixing,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_quality_line_crf": op10_quality_line_crf,
}
ORACLE_SQL: dict[str, str] = {"op1_warc_normalise": OP1_SQL, "op2_chat_formatting": OP2_SQL, "op4_minhash_near_dedup": OP4_SQL, "op7_bm25_search": OP7_SQL}
