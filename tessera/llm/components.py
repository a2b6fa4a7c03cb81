"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One contraction of undirected ``pairs(a, b)``; each step is a partial minimum and one join on ``a``."""
    if large:
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.unionByName(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _settled(pairs: DataFrame) -> bool:
    """Whether every node points at one root and no root points on."""
    ends = pairs.select(F.col("a").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(pairs.select(F.col("b").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return nodes.where("out > 1 OR out = 1 AND into = 1").limit(1).count() == 0


def connected_components(pairs: DataFrame, work: Workspace, max_rounds: int = 60) -> DataFrame:
    """``pairs(a, b)`` of any ordered type -> ``(node, component)`` with the smallest reachable node.

    Nodes without a pair do not appear. Every round writes its pairs to the shared folder, so lineage
    stays short; the driver sees one count a round and never a link. Null endpoints and loops drop
    out; repeated pairs count once; an empty input gives an empty result.
    """
    now = work.table(pairs.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    for _ in range(max_rounds):
        if _settled(now):
            break
        new = work.table(_star(_star(now, True), False), "star")
        work.drop(now)
        now = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()
