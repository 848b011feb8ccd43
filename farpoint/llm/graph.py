"""Connected components of an edge list, by alternating large and small stars.

Every round links each node to the least node known around it. Minima are partial aggregates
and are joined back, so a node with very many edges is split by the planner, not gathered; each
round is written to the checkpoint folder. Rounds run in as many partitions as their edges need, as
every exchange costs files by its partitions; what earlier rounds wrote is let go.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farpoint.llm.common import checkpoint, sweep

#: Edges of a partition, about.
EDGES = 250_000


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """edges (a > b). Large: neighbours above a node go to its minimum; small: those below do."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    near = both.join(least, "a")
    moved = near.filter(F.col("b") > F.col("a")) if large else near.filter(F.col("b") != F.col("m"))
    out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").coalesce(parts).distinct().coalesce(parts)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node of its component."""
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    e = checkpoint(e)
    parts = max(1, math.ceil(e.count() / EDGES))
    e = e.coalesce(parts)
    seen = None
    for _ in range(rounds):
        e = checkpoint(_star(_star(e, True, parts), False, parts))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    sweep(edges.sparkSession)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
