"""The query of each operator, with production parameters over its whole table, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import ann, chat, html_extract, mixing, packing, quality, simhash, url_filter, warc
from weftgraph.llm.common import read, small_batches

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    # a page shows the document whose number is in its path, so that document's label is the url's
    number = F.regexp_extract(url_filter.path_of(F.col("url")), "/([0-9]+)", 1)
    spread = F.lit(-1) - F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 40))  # urls without a number match nothing, and not in one task
    pages = pages.withColumn("url_key", F.when(F.length(number).between(1, 18), number.cast("long")).otherwise(spread))
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("url_key"), F.greatest(1 - F.col("quality"), F.col("toxic")).alias("bad"))
    labels = labels.groupBy("url_key").agg(F.max("bad").alias("bad"))
    out = url_filter.judge(pages, labels)
    return out.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 9).alias("purity"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = chat.digests(chat.format_conversations(rows.unionByName(extra), chat.ChatParams(TOKENIZER)))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = html_extract.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "text_path")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), packing.PackParams(TOKENIZER))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = simhash.edited_fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text"))
    # the distinct fingerprints within 3 of 128 bits, searched for every hundredth document
    return simhash.with_near(out, F.col("doc_id") % 100 == 0, simhash.TableParams(radius=3, bits=128, blocks=5)).drop("prints")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(rows, F.col("vec_id") % 20 == 0)


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select("doc_id", quality.grade(F.col("quality"), F.col("toxic")).alias("grade"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, graded(spark, sf_dir))
    return quality.score(docs, model).select("doc_id", F.round("expected_grade", 9).alias("expected_grade"), F.round("tail_probability", 9).alias("tail_probability"), "keep")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = warc.archive_pages(spark, read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    f.__name__: f
    for f in (op1_url_filter, op2_chat_format, op3_html_extract, op4_mix_sources, op5_pack, op6_fingerprint, op7_simhash_dedup, op8_ann, op9_quality, op10_warc)
}

SQL: dict[str, str] = {}

SQL["op1_url_filter"] = url_filter.judge_sql("CASE WHEN length(regexp_extract(path, '/([0-9]+)', 1)) BETWEEN 1 AND 18 THEN CAST(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT) END")

SQL["op2_chat_format"] = r"""WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, t, CASE WHEN t = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(t)),
e AS (SELECT *, length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 23 AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum(chars) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""

SQL["op4_mix_sources"] = mixing.mix_sql()

#: All pairs, summed from the first component to the last: equal where the table fills one partition, which is searched whole.
SQL["op8_ann"] = """WITH e AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = (SELECT mode(len(embedding)) FROM embeddings) AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

SQL["op10_warc"] = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keep FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN keep END AS refers_to FROM g"""
