"""What callers do around scoring, as DataFrame operations."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Clusters up to this number have their statistics broadcast.
FEW = 100_000
#: Ranges of scores that a rank sum is taken in.
RANGES = 256


def above(scored: DataFrame, threshold: float) -> DataFrame:
    """Rows whose score is over the threshold; NaN never is."""
    return scored.filter((F.col("score") > threshold) & ~F.isnan("score"))


def top(scored: DataFrame, n: int) -> DataFrame:
    """The n highest scores, ties to the smaller id; a TakeOrdered, not a sort."""
    return scored.filter(~F.isnan("score")).orderBy(F.desc("score"), "id").limit(n)


def attach(df: DataFrame, scored: DataFrame, id_col: str) -> DataFrame:
    """Rows of df with their score."""
    return df.join(scored.select(F.col("id").alias(id_col), "score"), id_col, "left")


def _moments_in_order(df: DataFrame, columns: list[str], by: str, order: str) -> DataFrame:
    """(_by, _m0, _d0, ..): mean by a running sum and deviation by Welford's recurrence, one row after another.

    Sums of doubles depend on their order, and values that tie but for it are told apart by it. A task passes
    through the rows of its clusters and holds none of them.
    """
    def close(value, n: int, sums: list, squares: list) -> tuple:
        return value, *[v for s, q in zip(sums, squares, strict=True) for v in (s / n, math.sqrt(max(q, 0.0) / n))]

    def run(frames):
        now, n, sums, means, squares = None, 0, [], [], []
        names = ["_by", *[f"_{x}{i}" for i in range(len(columns)) for x in "md"]]
        for f in frames:
            out = []
            for value, g in f.groupby("_by", sort=False):
                if n and value != now:
                    out.append(close(now, n, sums, squares))
                    n = 0
                if not n:
                    now, sums, means, squares = value, [0.0] * len(columns), [0.0] * len(columns), [0.0] * len(columns)
                for i in range(len(columns)):
                    s, m, q, at = sums[i], means[i], squares[i], n
                    for x in g[f"_x{i}"].tolist():
                        at += 1
                        s += x
                        d = x - m
                        m += d / at
                        q += d * (x - m)
                    sums[i], means[i], squares[i] = s, m, q
                n += len(g)
            if out:
                yield pd.DataFrame(out, columns=names)
        if n:
            yield pd.DataFrame([close(now, n, sums, squares)], columns=names)

    rows = df.filter(F.col(by).isNotNull()).select(F.col(by).alias("_by"), F.col(order).alias("_o"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    dealt = rows.repartition("_by").sortWithinPartitions("_by", "_o").drop("_o")
    kinds = ", ".join(f"_m{i} double, _d{i} double" for i in range(len(columns)))
    return dealt.mapInPandas(run, f"_by {dict(rows.dtypes)['_by']}, {kinds}")


def zscores(df: DataFrame, columns: list[str], by: str, groups: int | None = None, order: str | None = None) -> DataFrame:
    """df with (x - mean) / population deviation within a cluster in place of each column; 0 where all are equal.

    Two moments per cluster are joined back; no task holds a cluster. ``groups``, where known, decides
    whether they are broadcast. With ``order``, a column, moments are rounded as a pass in that order rounds them, for
    clusters and columns without missing values; a cluster is then passed through by one task.
    """
    if order is None:
        moments = [f(c).alias(f"_{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("d", F.stddev_pop))]
        per = df.groupBy(F.col(by).alias("_by")).agg(*moments)
    else:
        per = _moments_in_order(df, columns, by, order)
    out = df.join(F.broadcast(per) if groups is not None and groups <= FEW else per, F.col(by).eqNullSafe(F.col("_by")))
    score = lambda i, c: F.when(F.col(f"_d{i}") == 0, 0.0).otherwise((F.col(c) - F.col(f"_m{i}")) / F.when(F.col(f"_d{i}") == 0, 1.0).otherwise(F.col(f"_d{i}")))
    return out.withColumns({c: score(i, c) for i, c in enumerate(columns)}).select(df.columns)


def rmse(a: str, b: str) -> Column:
    d = F.col(a) - F.col(b)
    return F.sqrt(F.avg(d * d))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row ``auc`` by rank sum. Scores are counted by value and ranked within ranges of scores.

    Ranges are cut at quantiles, and the totals of the ranges before, one number each, are added.
    """
    per = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).persist()
    cuts = sorted({c for c in per.approxQuantile("s", [i / RANGES for i in range(1, RANGES)], 1 / (4 * RANGES)) if not math.isnan(c)})
    inside = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("s"))) if cuts else F.lit(0)
    ranged = per.withColumn("range", inside)
    totals = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # at most RANGES rows
    before, total = [], 0
    for i in range(len(cuts) + 1):
        before.append(total)
        total += totals.get(i, 0)
    w = Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("n").over(w), F.lit(0)) + F.get(F.array(*map(F.lit, before)), F.greatest("range", F.lit(0)))
    u = F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0))
    pairs = F.sum("p") * F.sum("n")
    return ranged.withColumn("below", below).agg(F.when(pairs > 0, u / F.when(pairs > 0, pairs).otherwise(1)).alias("auc"))


def suggested_neighbours(rows: int) -> int:
    """The odd integer near sqrt(rows)."""
    k = max(1, round(math.sqrt(rows)))
    return k if k % 2 else k + 1


def without_self(edges: DataFrame, k: int) -> DataFrame:
    """Brought edges (id, rank, nid, dist, ...) without each row's edge to itself; the k nearest of the rest, ranked anew."""
    w = Window.partitionBy("id").orderBy("rank")
    return edges.filter("id <> nid").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    return df.orderBy(F.rand(seed))


def split_by_key(df: DataFrame, key: str, modulus: int, remainder: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose key leaves another remainder, rows whose key leaves this one)."""
    hit = F.col(key) % modulus == remainder
    return df.filter(~hit), df.filter(hit)


def k_ensemble(edges_of_largest: DataFrame, ks: tuple[int, ...], extent: int = 3) -> DataFrame:
    """(id, cluster, score): mean score over several k from one neighbour search with the largest."""
    from farpoint.operators.scoring import score_edges

    edges = edges_of_largest.persist()
    out = None
    for k in ks:
        one = score_edges(edges.filter(F.col("rank") <= k), k, extent).select("id", "cluster", "score")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("id", "cluster").agg(F.avg("score").alias("score"))
