"""Registered queries of the text operators: whole tables in, digest columns of each contract out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from scenelake.llm import adaptive_rules, conversation_trie, decontaminate, license_scan, lm_score, ngram_join, packing, pii_weak, quality_pu, secret_scan, span_dedup, suffix_levels, whitening
from scenelake.llm.common import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def tokenizer() -> tuple[str, str, dict[str, int]]:
    """Vocabulary file (as ranks), cutting pattern and special tokens of the public 50k byte-level vocabulary."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special


# --- 1 n-gram Jaccard join
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(read(spark, sf_dir, "documents"))


QUERIES["op1_ngram_jaccard_join"] = op1_ngram_jaccard_join

# --- 2 benchmark decontamination
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.find_items(documents, benchmark))


QUERIES["op2_benchmark_decontamination"] = op2_benchmark_decontamination

# --- 3 substring dedup
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.dedup(read(spark, sf_dir, "documents"))


QUERIES["op3_substring_dedup"] = op3_substring_dedup

# --- 4 language-model scoring
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_corpus(read(spark, sf_dir, "documents"))


QUERIES["op4_lm_scoring"] = op4_lm_scoring

# --- 5 quality classifier
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES["op5_quality_classifier"] = op5_quality_classifier

# --- 6 best-fit packing
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer())


QUERIES["op6_best_fit_packing"] = op6_best_fit_packing

# --- 7 quality rules
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_rules.judge(read(spark, sf_dir, "documents"))


QUERIES["op7_quality_rules"] = op7_quality_rules

# --- 8 license scans
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


QUERIES["op8_license_scan"] = op8_license_scan

# --- 9 suffix-array dedup
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.digest(suffix_levels.repeated_bytes(read(spark, sf_dir, "documents")))


QUERIES["op9_suffix_array_dedup"] = op9_suffix_array_dedup

# --- 10 personal data
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_weak.find(read(spark, sf_dir, "documents"))


QUERIES["op10_pii"] = op10_pii

# --- 11 conversation prefix trie
def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.build(read(spark, sf_dir, "conversations"))


QUERIES["op11_conversation_prefix_trie"] = op11_conversation_prefix_trie
# A node is the text of its turns here; the crc32 of an id is taken byte by byte.
SQL["op11_conversation_prefix_trie"] = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, list_reduce(
    [4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS inverted
  FROM (SELECT DISTINCT conv_id FROM turns)
), heads AS (
  SELECT conv_id, base, xor(inverted, 4294967295) % 4 AS h FROM convs
), rebuilt AS (
  SELECT c.conv_id, t.pos, t.role, t.text FROM heads c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos, t.role, t.text FROM heads c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
), numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, role, text FROM rebuilt
), paths AS (
  SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) AS path
  FROM (SELECT conv_id, depth, role, text FROM numbered)
), members AS (
  SELECT conv_id, depth, path, words FROM paths
  UNION ALL SELECT conv_id, 0, '', 0 FROM heads
), lengths AS (
  SELECT conv_id, max(depth) AS turns FROM members GROUP BY conv_id
), nodes AS (
  SELECT m.path, m.depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, any_value(m.words) AS words,
    sha256(coalesce(string_agg(CASE WHEN l.turns = m.depth THEN m.conv_id::VARCHAR END, ',' ORDER BY m.conv_id), '')) AS ends_sha256
  FROM members m JOIN lengths l USING (conv_id) GROUP BY m.path, m.depth
), linked AS (
  SELECT n.path, n.depth, n.conv_id, n.n_convs, n.words, n.ends_sha256, p.path AS parent_path, q.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN members p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
  LEFT JOIN nodes q ON q.path = p.path AND q.depth = p.depth
), children AS (
  SELECT parent_path, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT l.*, coalesce(c.n_children, 0) AS n_children FROM linked l LEFT JOIN children c ON c.parent_path = l.path AND c.depth = l.depth
), above AS (
  SELECT m.path, m.depth, count(*) FILTER (WHERE c.n_children = 0) AS n_leaves, sum((c.n_convs - 1) * c.words) AS saved_tokens
  FROM counted c JOIN members m ON m.conv_id = c.conv_id AND m.depth <= c.depth GROUP BY m.path, m.depth
)
SELECT c.conv_id::BIGINT AS conv_id, c.depth::BIGINT AS depth, c.parent_conv_id::BIGINT AS parent_conv_id, c.n_convs::BIGINT AS n_convs,
  c.n_children::BIGINT AS n_children, a.n_leaves::BIGINT AS n_leaves, a.saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN above a ON a.path = c.path AND a.depth = c.depth
"""

# --- 12 secrets
def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find(read(spark, sf_dir, "documents")))


QUERIES["op12_secret_scans"] = op12_secret_scans

# --- 13 whitening of embeddings
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


QUERIES["op13_embedding_whitening"] = op13_embedding_whitening
