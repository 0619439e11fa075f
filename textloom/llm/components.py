"""Connected components of an edge table by alternating stars.

Every round hangs a node's larger neighbours on its smallest one (large star), then its smaller ones
(small star). Rounds are few: the number of steps grows with the logarithm of the longest path. Each step
aggregates with map-side partials and joins, so a hub with very many edges is split like any skewed key;
lineage is cut after each round by a table in the shared folder, which goes with the next one. Nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import materialize, remove

MAX_ROUNDS = 40


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a > b."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    met = both.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = met.where("b < a").select("a", F.col("m").alias("b"))
        out = out.union(own)
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(met.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every node hangs on one other at most, and none hangs on a hanging one.
    One exchange of partial aggregates, in place of a whole round that changes nothing."""
    hangs = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root"))
    holds = edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root"))
    nodes = hangs.union(holds).groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return nodes.where("up > 1 or (up = 1 and root = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of type long); root is the smallest node of
    its component and has a row of its own. Self-loops and repeated edges do no harm."""
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    made: list[str] = []
    now = materialize(now, "edges", made)
    for _ in range(MAX_ROUNDS):
        if _settled(now):
            break
        now = materialize(_star(_star(now, True), False), "edges", made)
        remove(edges.sparkSession, made[-2:-1])
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
