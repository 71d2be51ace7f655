"""The dealt operators as queries over whole tables, with production parameters, and their SQL checks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnkit.llm import alignment, bpe, chat, jaccard_join, langid, lm, packing, quality, runs, simhash, suffix_dedup, topk, warc
from tarnkit.llm.tables import table


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = bpe.encode(table(spark, folder, "documents"), path).withColumns({
        "n_tokens": F.size("ids").cast("long"),
        "ids_sha256": F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256)})
    return bpe.decode(ids, path, keep=("doc_id", "n_tokens", "ids_sha256")).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_chat(spark: SparkSession, folder: str) -> DataFrame:
    mask = F.array_join(F.transform("mask", lambda x: F.concat_ws("-", x["begin"], x["end"])), ",")
    return chat.rotate(table(spark, folder, "conversations")).withColumn("mask", mask)


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, folder, "documents"))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.groups(table(spark, folder, "documents")).select(
        "doc_id", simhash.hex_print().alias("fingerprint"), "component_id")


def op5_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(table(spark, folder, "documents"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_and_read(table(spark, folder, "pages"))


def op7_langid(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"))


def op11_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.join(table(spark, folder, "documents"))


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    paths = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.link_counts(table(spark, folder, "documents"), *paths)


def op13_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.runs(table(spark, folder, "documents"), periodic_tails=True)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_chat": op2_chat,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_simhash": op4_simhash,
    "op5_lm": op5_lm,
    "op6_warc": op6_warc,
    "op7_langid": op7_langid,
    "op8_packing": op8_packing,
    "op9_topk": op9_topk,
    "op10_quality": op10_quality,
    "op11_jaccard": op11_jaccard,
    "op12_alignment": op12_alignment,
    "op13_runs": op13_runs,
}
CHECKS: dict[str, str] = {
    "op2_chat": """
WITH clean AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role,
    replace(coalesce(text, ''), '<|im_', '<| im_') AS text FROM conversations),
  speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM clean WHERE role <> 'system'),
  views AS (SELECT c.conv_id, speaker, CAST(coalesce(floor(turn / 256), 9223372036854775807) AS BIGINT) AS part, turn, role, text,
      '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant'
        ELSE 'user name=' || role END || chr(10) AS head, text || '<|im_end|>' || chr(10) AS body
    FROM clean c JOIN speakers s ON c.conv_id IS NOT DISTINCT FROM s.conv_id),
  laid AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, part ORDER BY turn, role, text
      ROWS UNBOUNDED PRECEDING) AS stop FROM views)
SELECT conv_id, speaker, part, CAST(0 AS BIGINT) AS slice, CAST(0 AS BIGINT) AS share, count(*) AS n_turns,
  string_agg(head || body, '' ORDER BY turn, role, text) AS text,
  coalesce(string_agg(CASE WHEN role = speaker THEN (stop - length(body)) || '-' || stop END, ',' ORDER BY turn, role, text, stop), '') AS mask
FROM laid GROUP BY conv_id, speaker, part""",
    "op6_warc": """
WITH rows AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM rows""",
    "op9_topk": """
WITH rows AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  cells AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS d, len(v) AS n FROM rows),
  sums AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
    FROM cells q JOIN cells c ON q.d = c.d AND q.n = c.n AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM sums QUALIFY rank <= 5""",
}
