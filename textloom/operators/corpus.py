"""The corpus pipeline as one plan: clean, cut to size, drop copies, chunk, filter, drop copies."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.wikitext import clean_wikitext
from textloom.operators import chunking
from textloom.session import materialize


def stride_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """S16 in the shape of ``chunk_documents``."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(chunking.fixed_stride(F.col(text))).alias("ord", "chunk_text")).select(*rest, "ord", F.lit("").alias("section"), "chunk_text")


def build(
    docs: DataFrame,
    clean: Callable[[Column], Column] = clean_wikitext,
    chunk: Callable[[DataFrame], DataFrame] = chunking.chunk_documents,
    script: Callable[[Column], Column] = T.cjk_ratio,
    least_doc: int = 200,
    least_chunk: int = 50,
    least_script: float = 0.3,
    most_share: float = 0.4,
) -> tuple[DataFrame, DataFrame]:
    """The chunks of ``docs`` (doc_id, text) and one row of ten statistics.

    Each of the two removals of copies is one exchange that also counts what goes: rows to be dropped are
    one group without a text, which every task reduces to one row before the exchange. Of equal texts the
    smallest doc_id (and place) stays. A null text is empty; without documents there are no chunks, and
    the rates are 1 - 0 / 1, as the divisors are 1 at least."""
    begun = time.time()
    cleaned = docs.select("doc_id", clean(F.coalesce("text", F.lit(""))).alias("text"))
    kept = cleaned.select("doc_id", "text", F.when(F.length("text") >= least_doc, F.md5("text")).alias("doc_hash"))
    first = F.min_by(F.struct("doc_id", "text"), "doc_id")
    one = kept.withColumn("text", F.when(F.col("doc_hash").isNotNull(), F.col("text"))).groupBy("doc_hash").agg(F.count("*").alias("copies"), first.alias("d"))
    held = materialize(one.select("doc_hash", "copies", "d.*"), "corpus-docs")

    chunks = chunk(held.where("doc_hash is not null").select("doc_id", "doc_hash", "text"))
    rated = chunks.withColumns({"char_len": F.length("chunk_text"), "script_ratio": script(F.col("chunk_text")), "share": T.max_char_share(F.col("chunk_text"))})
    good = (F.col("char_len") >= least_chunk) & (F.col("script_ratio") >= least_script) & (F.col("share") <= most_share)
    keyed = rated.withColumn("chunk_id", F.when(good, F.md5("chunk_text")))
    columns = ["doc_id", "doc_hash", "ord", "section", "chunk_text", "char_len", "script_ratio"]
    row = F.when(F.col("chunk_id").isNotNull(), F.struct(*columns))
    final = keyed.groupBy("chunk_id").agg(F.count("*").alias("copies"), F.min_by(row, F.struct("doc_id", "ord")).alias("c"))
    out = materialize(final.select("chunk_id", "copies", "c.*"), "corpus-chunks")

    least = lambda c: F.greatest(c, F.lit(1))
    total = lambda among=F.lit(True): F.coalesce(F.sum(F.when(among, F.col("copies"))), F.lit(0))
    of_docs = held.agg(total().alias("raw_docs"), total(F.col("doc_hash").isNotNull()).alias("clean_docs"), F.count("doc_hash").alias("dedup_docs"))
    of_chunks = out.agg(total().alias("chunks_before_filter"), F.count("chunk_id").alias("chunks_final"))
    took = time.time() - begun
    c = F.col
    stats = of_docs.join(F.broadcast(of_chunks)).select(  # one row each
        "*",
        F.round(c("chunks_final") / least(c("dedup_docs")), 2).alias("avg_chunks_per_doc"),
        F.round(1 - c("dedup_docs") / least(c("clean_docs")), 4).alias("doc_dedup_rate"),
        F.round(1 - c("chunks_final") / least(c("chunks_before_filter")), 4).alias("chunk_filter_rate"),
        F.lit(round(took, 1)).alias("elapsed_sec"),
        F.round(c("raw_docs") / F.lit(max(took, 1e-6)), 1).alias("throughput_docs_per_sec"),
    )
    return out.where("chunk_id is not null").drop("copies"), stats
