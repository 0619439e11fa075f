"""Queries of the training-data operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm.bpe import bpe_round_trip
from textloom.llm.brown import class_scores
from textloom.llm.html_text import extract_text
from textloom.llm.jaccard import jaccard_classes
from textloom.llm.licenses import license_scan
from textloom.llm.media import media_columns, media_digests
from textloom.llm.packing import pack_digests, pack_documents
from textloom.llm.pii import pii_digest
from textloom.llm.quality import quality_verdicts
from textloom.llm.toxicity import toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(media_columns(_read(spark, sf_dir, "documents")))


def op2_toxicity_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_digests(pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_read(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_round_trip(_read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_read(spark, sf_dir, "pages"))


def op7_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_scores(_read(spark, sf_dir, "documents"))


def op8_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_read(spark, sf_dir, "documents")).drop("text_hash")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(_read(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_media_columns,
        op2_toxicity_instances,
        op3_tiered_packing,
        op4_license_scan,
        op5_byte_bpe,
        op6_html_text,
        op7_class_ngrams,
        op8_quality_outliers,
        op9_personal_data,
        op10_ngram_jaccard,
    )
    return {f.__name__: f for f in found}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_OP10 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), items AS (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
  WHERE 100 * c >= 75 * (len(p.s) + len(q.s) - c)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id
FROM sets JOIN (SELECT node, min(root) AS component_id FROM reach GROUP BY node) ON node = doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_ngram_jaccard": ORACLE_OP10}
