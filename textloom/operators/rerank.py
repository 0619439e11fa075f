"""Reranking of a fused pool. The scorer is a hook over columns: a model comes as a
pandas UDF of (question, passage), the default is lexical and stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import tokens
from textloom.operators import ranking

Scorer = Callable[[Column, Column], Column]
SPECIAL = 4


def lexical_scorer(question: Column, passage: Column) -> Column:
    """Share of the question's distinct words that the passage has; 0 for a question without words."""
    words = F.array_distinct(tokens(question))
    return F.round(F.when(F.size(words) > 0, F.size(F.array_intersect(words, tokens(passage))) / F.size(words)).otherwise(0.0), 6)


def words_length(text: Column) -> Column:
    return F.size(tokens(text))


def is_truncated(question: Column, passage: Column, max_length: int, length: Callable[[Column], Column] = words_length) -> Column:
    """Whether question, passage and the pair's special tokens exceed ``max_length``."""
    return length(passage) > F.lit(max_length) - length(question) - SPECIAL


def rerank(pool: DataFrame, topk: int, scorer: Scorer = lexical_scorer, query: str = "item_id") -> DataFrame:
    """``pool`` has the question (``question``), passage (``text``) and ``rank``; adds score and new_rank
    by score, then old rank, and keeps ``topk``. Null texts score as empty ones."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    w = Window.partitionBy(query).orderBy(F.desc("rerank_score"), "rank")
    scored = pool.withColumn("rerank_score", scorer(empty("question"), empty("text")))
    return scored.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= topk).withColumn("new_rank", F.col("new_rank").cast("long"))


def retrieve(ranked: DataFrame, docs: DataFrame, queries: DataFrame, topk: int = 5, pool: int = 50, rrf_k: int = 10, scorer: Scorer = lexical_scorer, query: str = "item_id", key: str = "doc_id") -> DataFrame:
    """Fuse to the pool (not to topk), fetch texts, rerank the pool, keep topk. Ids without a text leave
    gaps in the ranks."""
    if pool < topk:
        raise ValueError("the pool is smaller than what is to be kept")
    fused = ranking.rrf(ranked, k=rrf_k, topn=pool, query=query, key=key)
    fetched = fused.join(docs.select(key, "text"), key).join(queries.select(query, F.col("text").alias("question")), query)
    return rerank(fetched, topk, scorer, query)


def migration(reranked: DataFrame, gold: DataFrame, query: str = "item_id", key: str = "doc_id") -> DataFrame:
    """One row: gold documents that rose, fell or stayed."""
    at = reranked.join(gold.select(query, key), [query, key])
    return at.agg(
        F.count_if(F.col("new_rank") < F.col("rank")).alias("improved"),
        F.count_if(F.col("new_rank") > F.col("rank")).alias("worse"),
        F.count_if(F.col("new_rank") == F.col("rank")).alias("same"),
    )
