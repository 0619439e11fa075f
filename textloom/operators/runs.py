"""Comparing runs. A run is a table of one row a question or a configuration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSED = 1_000_000_000


def align(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row: questions of both runs, of one only, and those of both for which ``value`` (boolean, null
    as false) holds in one only. Keys are taken to be distinct."""
    good = F.coalesce(F.col(value), F.lit(False))
    both = a.select(key, good.alias("a")).join(b.select(key, good.alias("b")), key, "full_outer")
    met = F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.agg(
        F.count_if(met).alias("aligned"),
        F.count_if(F.col("b").isNull()).alias("missing_in_b"),
        F.count_if(F.col("a").isNull()).alias("missing_in_a"),
        F.count_if(met & F.col("a") & ~F.col("b")).alias("only_a"),
        F.count_if(met & ~F.col("a") & F.col("b")).alias("only_b"),
    )


def deltas(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str], digits: int = 4) -> DataFrame:
    """Each metric of both runs and b - a, for the keys that both have."""
    left = a.select(*keys, *[F.col(m).alias(f"{m}_a") for m in metrics])
    both = left.join(b.select(*keys, *[F.col(m).alias(f"{m}_b") for m in metrics]), keys)
    return both.select("*", *[F.round(F.col(f"{m}_b") - F.col(f"{m}_a"), digits).alias(f"{m}_delta") for m in metrics])


def controls(metrics: DataFrame, config: str, columns: list[str]) -> DataFrame:
    """M9: configurations that no run should change: their number of different results, and whether it is 1.
    Nulls are a value of their own."""
    return metrics.groupBy(config).agg(F.count("*").alias("runs"), F.count_distinct(F.struct(*columns)).alias("results")).withColumn("same", F.col("results") == 1)


def winner(ranks: dict[str, Column]) -> Column:
    """M7: the name of the smallest rank, 'tie' where several have it; a missed one counts as MISSED."""
    filled = {name: F.coalesce(rank, F.lit(MISSED)) for name, rank in ranks.items()}
    best = F.least(*filled.values())
    holders = reduce(lambda x, y: x + y, [(r == best).cast("int") for r in filled.values()])
    return reduce(lambda chain, item: chain.when(item[1] == best, item[0]), filled.items(), F.when(holders > 1, "tie"))


def median_by(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """M7: rows, and the median of ``value`` among those that have one."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.percentile(value, F.lit(0.5)), 6).alias(f"median_{value}"))
