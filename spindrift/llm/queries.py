"""Registered queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, quality_sql
from .decontamination import decontaminate
from .line_dedup import line_dedup
from .lm_score import lm_scores
from .packing import pack_tokens
from .prefix_trie import conversation_trie
from .quality import quality_rules
from .secrets import BASE, secret_scan
from .sentencepiece_codec import sentencepiece_encode
from .sharding import assign_shards
from .simhash import fingerprint_hex, near_duplicates
from .suffix_dedup import repeated_strings
from .token_alignment import align_tokens
from .token_counts import token_counts

PIECES = "piece_bpe_32k.model"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP1_SQL = """
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM benchmark
), phrases AS (
  SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS phrase
  FROM (SELECT item, ws, least(13, len(ws)) AS n, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM items WHERE len(ws) > 0)
), windows AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM phrases) WHERE len(ws) >= n)
), hits AS (
  SELECT doc_id, i, n, item FROM windows JOIN phrases USING (n, phrase)
), covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id
), owners AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN owners USING (doc_id)
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(common.read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = near_duplicates(common.read(spark, sf_dir, "documents"))
    return grouped.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op4_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(common.read(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_span_list(of(*BASE)), 256).alias("base_sha256"),
        _span_list(F.col("spans")).alias("spans"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeated_strings(common.read(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.aggregate("passages", F.lit(0).cast("long"), lambda n, p: n + p["end"] - p["start"]).alias("n_passage_words"),
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_encode(common.read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2(F.concat_ws(";", *(F.array_join(F.col(c).cast("array<string>"), ",") for c in ("starts", "ends"))), 256).alias("spans_sha256"),
    )


SHARDS, SLOTS = [f"shard-{k:02d}" for k in range(16)], 2039


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(common.read(spark, sf_dir, "documents"), SHARDS, size=SLOTS)
    return placed.select("doc_id", "slot", "shard", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


#: The shards claim slots by recursion, a turn a step: `taken` lists the claims so far.
OP9_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT k, 'shard-' || lpad(CAST(k AS VARCHAR), 2, '0') AS name FROM range(16) t(k)
), preferences AS (
  SELECT list((CAST('0x' || substr(md5(name || '/offset'), 1, 15) AS BIGINT)) % {SLOTS} ORDER BY k) AS first,
         list((CAST('0x' || substr(md5(name || '/skip'), 1, 15) AS BIGINT)) % {SLOTS - 1} + 1 ORDER BY k) AS skip
  FROM shards
), turns(t, slot, taken) AS (
  SELECT 0, CAST(NULL AS BIGINT), list_transform(range({SLOTS}), lambda x: false) FROM preferences
  UNION ALL
  SELECT t + 1, free, list_transform(taken, lambda x, i: x OR i = free + 1)
  FROM (
    SELECT t, taken, list_filter(list_transform(range({SLOTS}), lambda j: (first[t % 16 + 1] + j * skip[t % 16 + 1]) % {SLOTS}), lambda s: NOT taken[s + 1])[1] AS free
    FROM turns, preferences WHERE t < {SLOTS}
  )
)
SELECT doc_id, d.slot, name AS shard, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS slot FROM documents) d
JOIN (SELECT slot, (t - 1) % 16 AS k FROM turns WHERE t > 0) USING (slot) JOIN shards USING (k)
"""


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(common.read(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align_tokens(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path(PIECES), digest=True)
    return aligned.withColumnRenamed("groups", "groups_sha256")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(common.read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT r, doc_id, i, ls[i] AS line,
         translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM docs)
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM (SELECT DISTINCT k, doc_id FROM lines WHERE length(k) >= 40) GROUP BY k HAVING count(*) >= 5
), judged AS (
  SELECT r, i, line, s.k IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS dropped FROM lines LEFT JOIN shared s USING (k)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged JOIN docs USING (r) GROUP BY r
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(common.read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_quality_rules": op2_quality_rules,
        "op3_simhash": op3_simhash,
        "op4_token_packing": op4_token_packing,
        "op5_secret_scan": op5_secret_scan,
        "op6_token_counts": op6_token_counts,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_sharding": op9_sharding,
        "op10_lm_score": op10_lm_score,
        "op11_token_alignment": op11_token_alignment,
        "op12_line_dedup": op12_line_dedup,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": OP1_SQL,
        "op2_quality_rules": quality_sql.SQL,
        "op9_sharding": OP9_SQL,
        "op12_line_dedup": OP12_SQL,
    }
