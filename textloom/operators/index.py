"""A BM25 index on disk and its guards: tables terms, postings, stats, meta."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import bm25

PARTS = ("terms", "postings", "meta")


class Index(NamedTuple):
    terms: DataFrame
    postings: DataFrame
    meta: DataFrame


def build(docs: DataFrame, path: str, key: str = "doc_id", normaliser: str = "lower", min_df: int = bm25.MIN_DF, files: int | None = None) -> Index:
    """Writes the index. Postings are range-partitioned and sorted by term, so that a search reads only the
    row groups of its terms; the frequent terms' postings may spread over several files."""
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = bm25.posting_rows(docs, key, min_df).select("term", F.col(key).alias("doc_id"), "tf", "tf_norm")
    postings.repartitionByRange(files, "term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    terms = bm25.document_frequencies(docs, key, min_df)
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    sizes = spark.read.parquet(f"{path}/terms").agg(F.count("*").alias("n_terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("n_postings"))
    meta = bm25.corpus_stats(docs).join(F.broadcast(sizes))  # one row each
    meta.select("*", F.lit(normaliser).alias("normaliser"), F.lit(bm25.K1).alias("k1"), F.lit(bm25.B).alias("b")).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return load(spark, path, normaliser)


def load(spark: SparkSession, path: str, normaliser: str = "lower") -> Index:
    """Refuses an index whose parts are missing, whose numbers don't fit, or whose texts were
    normalised in another way than the questions will be."""
    try:
        index = Index(*(spark.read.parquet(f"{path}/{part}") for part in PARTS))
    except Exception as e:
        raise ValueError(f"incomplete index at {path}") from e
    meta = index.meta.first()
    if meta.normaliser != normaliser:
        raise ValueError(f"index normalised by {meta.normaliser}, questions by {normaliser}")
    if index.terms.count() != meta.n_terms or index.postings.count() != meta.n_postings:
        raise ValueError(f"index at {path} does not fit its meta data")
    return index


def broken_terms(index: Index) -> DataFrame:
    """B2: terms whose postings are not as many as their df."""
    held = index.postings.groupBy("term").agg(F.count("*").alias("held"))
    return index.terms.join(held, "term", "full_outer").where("not df <=> held")


def unknown_terms(index: Index, queries: DataFrame, query: str = "item_id") -> DataFrame:
    """The questions' terms that the index lacks."""
    return bm25.token_rows(queries, query).where("term is not null").select(query, "term").distinct().join(index.terms, "term", "left_anti")


def search(index: Index, queries: DataFrame, k: int, query: str = "item_id") -> DataFrame:
    """B3-B5 from the tables on disk. The postings of the questions' terms are shuffled to their document, where all
    questions meet it at once, and each task gives out k rows a question; a block of questions too large to
    send to every task is joined row by row."""
    spark, entries = queries.sparkSession, bm25.entries_of(queries, query)
    if entries is None:
        return _search_by_joins(index, queries, k, query)
    asked = spark.createDataFrame([(t,) for t in sorted({r["term"] for r in entries})], "term string")  # MAX_ENTRIES at most
    df = {r["term"]: r["df"] for r in index.terms.join(F.broadcast(asked), "term").collect()}
    weights = bm25.weights_of(entries, query, df, index.meta.first().n_docs)
    told = spark.sparkContext.broadcast(weights)
    numbers = F.broadcast(spark.createDataFrame([(t.decode(), i) for t, i in weights.terms.items()], "term string, number int"))
    rows = index.postings.join(numbers, "term").select("doc_id", "number", "tf_norm").repartition("doc_id").sortWithinPartitions("doc_id", "number")
    schema = f"{query} {dict(queries.dtypes)[query]}, doc_id {dict(index.postings.dtypes)['doc_id']}, score double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = told.value
        n, many = len(weights.questions), np.diff(weights.start)
        best, rest = bm25.Best(n, k), None

        def add(doc: np.ndarray, term: np.ndarray, norm: np.ndarray) -> None:
            first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            # as many whole documents at once as give bounded sums
            size = np.maximum(np.add.reduceat(many[term], first), n)
            group = np.cumsum(size) // bm25.ENTRIES
            for start in np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))):
                last = int(np.searchsorted(group, group[start], "right"))
                a, b = first[start], first[last] if last < len(first) else len(doc)
                number = np.searchsorted(first[start:last], np.arange(a, b), "right") - 1
                q, at, score, _ = weights.scores(number, term[a:b], norm[a:b])
                best.add(q, doc[first[start:last]][at], score)

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)] if rest else now
            cut = int(np.flatnonzero(np.concatenate(([True], now[0][1:] != now[0][:-1])))[-1])  # the last document may go on
            rest = [c[cut:] for c in now]
            if cut:
                add(*(c[:cut] for c in now))
        if rest:
            add(*rest)
        if found := best.result():
            q, docs, score = found
            yield pa.RecordBatch.from_arrays([pa.array([weights.questions[i] for i in q]), pa.array(docs), pa.array(score)], [query, "doc_id", "score"])

    return bm25.top_k(rows.mapInArrow(work, schema).withColumn("score", F.round("score", 6)), k, query)


def _search_by_joins(index: Index, queries: DataFrame, k: int, query: str) -> DataFrame:
    wanted = bm25.token_rows(queries, query).where("term is not null").groupBy(query, "term").agg(F.count("*").alias("qtf"))
    n = index.meta.select("n_docs")
    weighed = wanted.join(index.terms, "term").join(F.broadcast(n))  # a single row
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    found = weighed.select(query, "term", (idf * F.col("qtf")).alias("w")).join(index.postings, "term")
    return bm25.top_k(found.groupBy(query, "doc_id").agg(F.round(F.sum(F.col("tf_norm") * F.col("w")), 6).alias("score")), k, query)
