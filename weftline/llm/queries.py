"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audio import decode_audio, store_audio
from .bpe import decode, encode
from .digest import compare_with_next
from .lm_score import score_documents
from .packing import pack_documents
from .pii import BASE, find_pii, told
from .sharding import shard_by_bytes
from .shared import table
from .simhash import near_duplicates
from .toxicity import toxicity
from .url_filter import judge_urls

#: The rules that op8 applies.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels that aren't held out."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards under the law `bytes`."""
    out = shard_by_bytes(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash of 3-word shingles and its component."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's loss under the model of documents of good quality less that under the model of all others."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return score_documents(table(spark, sf_dir, "documents"), good)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts and digest of the base spans, and all spans."""
    out = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, BASE), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's digest beside its edited text's and the next document's."""
    return compare_with_next(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the five rules."""
    rules = spark.createDataFrame(URL_RULES, "action string, rule string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op9_bpe_encoding_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and what they decode to, as digests."""
    out = decode(encode(table(spark, sf_dir, "documents")))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as telephony audio, stored, read back and described; `pcm` is the resampled sound, stored with the rest."""
    out = decode_audio(store_audio(table(spark, sf_dir, "documents")))
    size = lambda c: F.octet_length(c).cast("long")
    return out.select(
        "doc_id",
        "n_bytes",
        size("payload").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        size("media").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "pcm",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_toxicity": op2_toxicity,
    "op3_sharding": op3_sharding,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_pii": op6_pii,
    "op7_document_fingerprints": op7_document_fingerprints,
    "op8_url_filters": op8_url_filters,
    "op9_bpe_encoding_decoding": op9_bpe_encoding_decoding,
    "op10_media_columns": op10_media_columns,
}

ORACLES: dict[str, str] = {
    # the table of CRC-32 from its polynomial, then a fold over each text's bytes
    "op3_sharding": """
WITH RECURSIVE bit(i, k, c) AS (
  SELECT i, 0, i::ubigint FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::ubigint) ELSE c >> 1 END FROM bit WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bit WHERE k = 8), told AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda h: ('0x' || h)::ubigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::bigint + 1])), 4294967295::ubigint)::bigint AS text_crc32 FROM documents, crc
), placed AS (
  SELECT *, row_number() OVER w - 1 AS nth, least(39, (2 * (sum(size) OVER w - size) + size) * 40 // (2 * sum(size) OVER ()))::int AS shard
  FROM told WINDOW w AS (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING)
)
SELECT doc_id, size::bigint AS size, text_crc32, 'bytes' AS law, shard, (nth - min(nth) OVER (PARTITION BY shard))::bigint AS slot, NULL::int AS grown_shard FROM placed
""",
    "op8_url_filters": """
WITH parsed AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parsed
), rules(action, host, path) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), pick AS (
  SELECT c.page_id, c.host, c.path, r.host || r.path AS rule, r.action,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS rn
  FROM cut c LEFT JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM pick WHERE rn = 1
""",
}
