"""From neighbour edges to Local Outlier Probabilities.

edges: (id, cluster, nid, d2), one row per neighbour; NULL or NaN d2 is a missing distance.
Every division is guarded, as ANSI mode raises on zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.functions.erf import erf_column
from farpoint.operators.recipes import FEW

WIDE = ["id", "cluster", "ssd", "std_dist", "pdist", "ev", "plof", "plof_ev", "nplof", "score"]


def nan() -> Column:
    return F.lit(float("nan"))


def mean_of_numbers(c: Column) -> Column:
    """avg that skips NaN; NaN where nothing is left."""
    return F.coalesce(F.avg(F.when(~F.isnan(c), c)), nan())


def same_number(a: Column, b: Column) -> Column:
    """Equality under which NaN equals nothing."""
    return (a == b) & ~F.isnan(a) & ~F.isnan(b)


def sum_squared(edges: DataFrame) -> DataFrame:
    """(id, cluster, ssd): the sum of squared distances over the neighbours."""
    return edges.groupBy("id", "cluster").agg(F.sum(F.coalesce("d2", nan())).alias("ssd"))


def standard_distance(ssd: DataFrame, k: int) -> DataFrame:
    """Adds std_dist = sqrt(ssd / k), k being the parameter, not the number of edges."""
    return ssd.withColumn("std_dist", F.sqrt(F.col("ssd") / float(k)))


def probabilistic_distance(std: DataFrame, extent: int) -> DataFrame:
    """Adds pdist = extent * std_dist."""
    return std.withColumn("pdist", F.lit(float(extent)) * F.col("std_dist"))


def expected_distance(edges: DataFrame, pdist: DataFrame) -> DataFrame:
    """pdist with ev, the mean pdist of the neighbours, which may lie in other clusters."""
    near = pdist.select(F.col("id").alias("nid"), F.col("pdist").alias("npd"))
    ev = edges.select("id", "nid").join(near, "nid", "left").groupBy("id").agg(mean_of_numbers(F.col("npd")).alias("ev"))
    return pdist.join(ev, "id")


def outlier_factor(base: DataFrame) -> DataFrame:
    """Adds plof = pdist / ev - 1, with ev = 0 read as 1e-8, and 0 throughout if pdist = ev in all rows.

    The guard is one row, attached by broadcast.
    """
    guard = base.agg(F.bool_and(same_number(F.col("pdist"), F.col("ev"))).alias("_level"))
    ev = F.when(F.col("ev") == 0, 1e-8).otherwise(F.col("ev"))
    plof = F.when(F.col("_level"), 0.0).otherwise(F.col("pdist") / ev - 1.0)
    return base.crossJoin(F.broadcast(guard)).withColumn("plof", plof).drop("_level")


def normaliser(plofs: DataFrame, extent: int, clusters: int | None = None) -> DataFrame:
    """Adds plof_ev, the cluster's mean plof squared, and nplof = extent * sqrt(plof_ev).

    Statistics of at most FEW clusters, where their number is known, are broadcast: a cluster may hold most rows.
    """
    square = F.col("plof") * F.col("plof")
    per = plofs.groupBy("cluster").agg(mean_of_numbers(square).alias("plof_ev"))
    per = F.broadcast(per) if clusters is not None and clusters <= FEW else per
    return plofs.join(per, "cluster").withColumn("nplof", F.lit(float(extent)) * F.sqrt("plof_ev"))


def probability(plof: Column, nplof: Column) -> Column:
    """plof / (nplof * sqrt 2) clamped at 0: what erf is taken of. 0/0 is NaN, x/0 infinite."""
    ratio = (
        F.when(F.isnan(plof) | F.isnan(nplof), nan())
        .when(nplof != 0, plof / (F.when(nplof != 0, nplof).otherwise(1.0) * math.sqrt(2.0)))
        .when(plof > 0, float("inf")).when(plof < 0, 0.0).otherwise(nan())
    )
    return F.greatest(F.lit(0.0), ratio)


def outlier_probability(normed: DataFrame) -> DataFrame:
    """Adds score in [0, 1]; 0 throughout if plof = nplof in all rows."""
    guard = normed.agg(F.bool_and(same_number(F.col("plof"), F.col("nplof"))).alias("_level"))
    y = normed.crossJoin(F.broadcast(guard)).withColumn("_y", probability(F.col("plof"), F.col("nplof")))
    return y.withColumn("score", F.when(F.col("_level"), 0.0).otherwise(erf_column("_y"))).drop("_level", "_y")


def score_edges(edges: DataFrame, k: int, extent: int = 3, clusters: int | None = None) -> DataFrame:
    """All stages; the columns of WIDE. Edges and distances are kept, as two stages read them; see release."""
    edges = edges.persist()
    pd = probabilistic_distance(standard_distance(sum_squared(edges), k), extent)
    base = expected_distance(edges, pd).persist()
    out = outlier_probability(normaliser(outlier_factor(base), extent, clusters)).select(WIDE)
    out._kept = [edges, base]
    return out


def release(scored: DataFrame) -> None:
    """Frees what score_edges keeps; the scores can still be computed, anew."""
    for df in getattr(scored, "_kept", []):
        df.unpersist()


def score_extents(edges: DataFrame, k: int, extents: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(extent, id, cluster, score): one pass for distances, shared by all extents."""
    edges = edges.persist()
    unit = expected_distance(edges, probabilistic_distance(standard_distance(sum_squared(edges), k), 1)).persist()
    out = None
    for x in extents:
        base = unit.withColumns({"pdist": F.col("pdist") * float(x), "ev": F.col("ev") * float(x)})
        one = outlier_probability(normaliser(outlier_factor(base), x)).select(F.lit(x).alias("extent"), "id", "cluster", "score")
        out = one if out is None else out.unionByName(one)
    return out


def model_stats(scored: DataFrame) -> DataFrame:
    """One row: max_nplof and mean_ev, all that scoring new rows needs besides the points."""
    return scored.agg(F.max("nplof").alias("max_nplof"), F.avg("ev").alias("mean_ev"), F.count(F.lit(1)).alias("rows"))
