"""Queries of this subpackage for the registry: opN_<name>, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from declq.llm import alignment, bpe, conversations, decontamination, fingerprints, hmm, line_dedup, ngram_join, oracles, quality_mil, quality_rules, sharding, token_counts, toxicity
from declq.llm.common import SHINGLE, SIMILARITY, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.line_frequency_filter(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", "depleted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars_left, n_removed, removed (line, first_doc, first_line) per document; the texts follow from them."""
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_left"), F.size("removed").cast("long").alias("n_removed"), "removed")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.interleave(table(spark, sf_dir, "documents"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = bpe.encoded_lengths(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_counts.suffix_sums(token_counts.length_histogram(lengths))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_language(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, output="digest")


def op11_spotsigs_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return alignment.scored_links(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(table(spark, sf_dir, "conversations"))


_OPERATORS: tuple[Query, ...] = (
    *(op1_toxicity, op2_quality_rules, op3_line_dedup, op4_ngram_jaccard_join, op5_quality_classifier, op6_sharding, op7_token_counts),
    *(op8_lm_scoring, op9_benchmark_decontamination, op10_byte_bpe, op11_spotsigs_fingerprints, op12_tokenizer_alignment, op13_conversation_repair),
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _OPERATORS}

_OP2_SQL = f"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents),
wins AS (
  SELECT doc_id, i, array_to_string(w[i:i+{quality_rules.WINDOW - 1}], ' ') AS win
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {quality_rules.WINDOW - 1})) AS i FROM words)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins),
marks AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + {quality_rules.WINDOW - 1})) AS p FROM again WHERE c > 1) GROUP BY doc_id),
lines AS (
  SELECT doc_id, host, array_to_string(list_filter(regexp_split_to_array(lower(x), '[\\x20\\x09-\\x0D]+'), lambda y: y <> ''), ' ') AS line,
         len(list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda y: y <> '')) AS n
  FROM (SELECT doc_id, host, unnest(ls) AS x FROM words)),
bad AS (SELECT host, line FROM lines GROUP BY host, line HAVING count(DISTINCT doc_id) > {quality_rules.MOST_DOCS_PER_HOST}),
gone AS (SELECT doc_id, sum(n) AS n FROM lines JOIN bad USING (host, line) GROUP BY doc_id),
base AS (
  SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(marks.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
  FROM words LEFT JOIN marks USING (doc_id) LEFT JOIN gone ON words.doc_id = gone.doc_id),
judged AS (
  SELECT *, n_words < {quality_rules.LEAST_WORDS} OR 100 * n_repeat_words > {quality_rules.MOST_REPEATED} * n_words AS base_failed,
         removed_words > 0 AND (n_words - removed_words < {quality_rules.LEAST_WORDS} OR n_words - removed_words < {quality_rules.LEAST_LEFT} * n_words) AS depleted
  FROM base)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM judged
"""

_WORDS_SQL = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_OP9_SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
iw AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+{SHINGLE - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - {SHINGLE - 1}, least(len(w), 1)))) AS i FROM dw)),
si AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i+{SHINGLE - 1}], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {SHINGLE - 1}, least(len(w), 1)))) AS i FROM iw)),
n AS (SELECT item_id, count(*) AS n_item FROM si GROUP BY item_id),
hits AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN si USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM hits JOIN n USING (item_id) WHERE n_shared >= {SIMILARITY} * n_item
"""

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": _OP2_SQL,
    "op9_benchmark_decontamination": _OP9_SQL,
    "op11_spotsigs_fingerprints": oracles.FINGERPRINTS,
    "op13_conversation_repair": oracles.REPAIR,
}
