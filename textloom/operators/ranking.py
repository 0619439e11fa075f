"""Fusion, leads and metrics of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rrf(ranked: DataFrame, k: int = 10, topn: int = 10, query: str = "item_id", key: str = "doc_id", weight: Column | None = None, paths: tuple[str, ...] = ()) -> DataFrame:
    """Sum of weight / (k + rank) over paths; ranks by fused score, ties by key. J3: for each of
    ``paths`` the rank that a row had there, null where it was not listed, from the same aggregation."""
    share = (F.lit(1.0) if weight is None else weight) / (k + F.col("rank"))
    fused = ranked.groupBy(query, key).agg(F.round(F.sum(share), 9).alias("fused"), *[F.max(F.when(F.col("path") == p, F.col("rank"))).alias(f"{p}_rank") for p in paths])
    w = Window.partitionBy(query).orderBy(F.desc("fused"), key)
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= topn).withColumn("rank", F.col("rank").cast("long"))


def convex(ranked: DataFrame, how: str, query: str = "item_id", key: str = "doc_id") -> DataFrame:
    """R2: scores scaled per query and path by min-max or z-score, then added with weights of one half."""
    w = Window.partitionBy(query, "path")
    if how == "minmax":
        low, high = F.min("score").over(w), F.max("score").over(w)
        scaled = (F.col("score") - low) / (high - low + 1e-12)
    else:
        scaled = (F.col("score") - F.avg("score").over(w)) / (F.stddev_pop("score").over(w) + 1e-12)
    return ranked.withColumn("scaled", scaled).groupBy(query, key).agg(F.round(F.sum(0.5 * F.col("scaled")), 6).alias("fused"))


def lead(ranked: DataFrame, query: str = "item_id") -> DataFrame:
    """(s1 - s2) / max(|s2|, 1e-9); null where a second is missing."""
    s1, s2 = (F.max(F.when(F.col("rank") == i, F.col("score"))) for i in (1, 2))
    return ranked.where("rank <= 2").groupBy(query).agg(F.round((s1 - s2) / F.greatest(F.abs(s2), F.lit(1e-9)), 6).alias("lead"))


def gated(ranked: DataFrame, margin: float, weak: float, strong: float, query: str = "item_id", path: str = "bm25") -> DataFrame:
    """The lexical path counts ``weak`` where its lead is below ``margin``, else ``strong``."""
    leads = lead(ranked.where(F.col("path") == path), query)
    weighted = ranked.join(leads, query, "left").withColumn(
        "weight", F.when(F.col("path") != path, 1.0).when(F.coalesce("lead", F.lit(0.0)) < margin, weak).otherwise(strong)
    )
    return rrf(weighted, weight=F.col("weight"), query=query)


def metrics(ranks: DataFrame, *by: str) -> DataFrame:
    """M2, M3 over rows of one query and configuration each (rank null: missed)."""
    hit = lambda k: F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))), 4).alias(f"recall_{k}")
    mrr = F.round(F.avg(F.when(F.col("rank") <= 10, 1.0 / F.col("rank")).otherwise(0.0)), 4).alias("mrr_10")
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), hit(1), hit(5), hit(10), mrr)


def by_mode(ranked: DataFrame, mode: str, k: int = 10, query: str = "item_id", key: str = "doc_id") -> DataFrame:
    """(query, key, score, rank) of one path of ``ranked`` (the mode is its name) or, as hybrid, of both
    fused from their whole lists."""
    if mode == "hybrid":
        return rrf(ranked, topn=k, query=query, key=key).select(query, key, F.col("fused").alias("score"), "rank")
    return ranked.where((F.col("path") == mode) & (F.col("rank") <= k)).select(query, key, "score", "rank")


def sign_test(wins: Column, losses: Column, one_sided: bool = False) -> Column:
    """Exact sign test, two-sided or (more wins than chance gives) one-sided, 1 without any difference. The binomial terms follow one from
    another, so that no factorial overflows; n is the number of questions that differ."""
    n, k = wins + losses, losses if one_sided else F.least(wins, losses)
    state = F.struct(F.pow(F.lit(0.5), n.cast("double")).alias("term"), F.lit(0.0).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        return F.struct((s.term * (n - i) / (i + 1)).alias("term"), (s.sum + s.term).alias("sum"))

    tail = F.aggregate(F.sequence(F.lit(0), k.cast("int")), state, step, lambda s: s.sum)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), tail if one_sided else 2 * tail))
