"""The queries of the numbered operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_kneser_ney_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lmscore import score_held_out

    return score_held_out(read_table(spark, sf_dir, "documents"))


def op2_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import audio_features, store_media

    found = audio_features(store_media(read_table(spark, sf_dir, "documents")))
    digest = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return found.select(F.col("id").alias("doc_id"), "n_bytes", *digest, "seconds", F.size("segments").alias("n_segments"), F.sha2("tensors", 256).alias("tensors_sha256"))


def op3_maximum_scoring_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import main_text

    return main_text(read_table(spark, sf_dir, "pages"))


def op4_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read_table(spark, sf_dir, "documents"), with_ids=False)


def op5_site_shrunken_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_prefix_filtered_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_simhash_anchor_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    return dedup_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed", "removed")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"))


def op10_wavelet_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import token_file

    return token_file(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_kneser_ney_scores, op2_audio_features, op3_maximum_scoring_text, op4_cost_balanced_packing, op5_site_shrunken_quality, op6_prefix_filtered_decontamination, op7_simhash_anchor_groups, op8_line_dedup, op9_token_counts, op10_wavelet_token_file)}

ORACLE_SQL: dict[str, str] = {
    "op6_prefix_filtered_decontamination": r"""
WITH item_words AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, words[s : s + 9] AS w
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS s FROM item_words WHERE len(words) > 0)),
doc_words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents),
sizes AS (SELECT DISTINCT len(w) AS k FROM windows),
doc_windows AS (
  SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS s FROM doc_words, sizes WHERE len(words) >= k),
found AS (
  SELECT d.doc_id, d.s, d.k, x.item_id
  FROM (SELECT doc_id, s, k, words[s : s + k - 1] AS w FROM doc_windows) d JOIN windows x ON d.w = x.w),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM found) GROUP BY doc_id),
item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id)""",
}
