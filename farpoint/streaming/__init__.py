"""Scoring new rows against a fitted model: stateless, so batch and streams share it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farpoint.errors import ValidationError
from farpoint.functions.erf import erf_column
from farpoint.functions.kernels import HAIR, squared_distances
from farpoint.operators import knn
from farpoint.operators.scoring import probability

#: A training matrix up to this size is broadcast; a larger one is joined block by block.
BROADCAST_BYTES = 64 << 20
#: A distance is recorded only below this; a NaN one never is.
FAR = 9e10
#: Private name of a sum of squared distances; rows to be scored may have any columns.
SSD = "_fp_ssd"


def finish(ssd: DataFrame, k: int, extent: int, mean_ev: float, max_nplof: float) -> DataFrame:
    """Adds score to rows that hold SSD, the sum of their k smallest squared distances. A column called score is replaced."""
    ev = mean_ev if mean_ev != 0 else 1e-8
    pdist = float(extent) * F.sqrt(F.col(SSD) / float(k))
    plof = F.when(pdist == mean_ev, 0.0).otherwise(pdist / ev - 1.0)
    y = ssd.withColumn("_fp_plof", plof).withColumn("_fp_y", probability(F.col("_fp_plof"), F.lit(float(max_nplof))))
    return y.withColumn("score", F.when(F.col("_fp_plof") == max_nplof, 0.0).otherwise(erf_column("_fp_y"))).drop("_fp_plof", "_fp_y", SSD)


def capped(d2: np.ndarray) -> np.ndarray:
    return np.where(d2 < FAR * FAR, d2, FAR * FAR)


class Near:
    """Sums of squared distances to the k nearest of a matrix's rows, exactly.

    Of equal rows k are enough. One feature: sorted values, of which the k on either side of a query are looked at.
    More: a balanced tree of boxes; the leaf a query falls into bounds its k-th distance, and then each box is
    visited once, by the queries whose bound it is within.
    """

    LEAF = 64

    def __init__(self, matrix: np.ndarray, k: int):
        self.k, self.width = k, matrix.shape[1]
        x = matrix[np.isfinite(matrix).all(axis=1)] + 0.0  # what is not finite is far from every row, as is what lacks
        x = x[np.lexsort(x.T[::-1])]
        new = np.ones(len(x), dtype=bool)
        new[1:] = (x[1:] != x[:-1]).any(axis=1)
        starts = np.flatnonzero(new)
        self.x = x[np.arange(len(x)) - np.repeat(starts, np.diff(np.r_[starts, len(x)])) < k]
        if self.width > 1:
            self._grow()

    def _grow(self) -> None:
        n, depth = len(self.x), 0
        while n >> (depth + 1) >= max(self.LEAF, 2 * self.k):
            depth += 1
        order, bounds = np.arange(n), [(0, n)]
        self.first_leaf = 2**depth - 1
        self.lo, self.hi = (np.full((2 ** (depth + 1) - 1, self.width), v) for v in (np.inf, -np.inf))
        self.dim, self.cut = np.zeros(self.first_leaf, dtype=int), np.zeros(self.first_leaf)
        for node in range(len(self.lo)):
            s, e = bounds[node]
            part = self.x[order[s:e]]
            if e > s:
                self.lo[node], self.hi[node] = part.min(axis=0), part.max(axis=0)
            if node < self.first_leaf:
                half, self.dim[node] = (e - s) // 2, int(np.argmax(self.hi[node] - self.lo[node]))
                at = part[:, self.dim[node]]
                by = np.argpartition(at, half) if half else np.arange(e - s)
                order[s:e] = order[s:e][by]
                self.cut[node] = at[by[half]] if e > s else 0.0
                bounds += [(s, s + half), (s + half, e)]
        self.x, self.bounds = self.x[order], bounds

    def sums(self, queries: np.ndarray) -> np.ndarray:
        """A query's sum; distances of FAR and more, and those that lack, count as FAR."""
        out = np.full(len(queries), self.k * FAR * FAR)
        fine = np.flatnonzero(np.isfinite(queries).all(axis=1))
        step = 4096  # bounds what is held at once
        for i in range(0, len(fine) if len(self.x) else 0, step):
            at = fine[i : i + step]
            out[at] = (self._line if self.width == 1 else self._tree)(queries[at])
        return out

    def _line(self, q: np.ndarray) -> np.ndarray:
        values, n = self.x[:, 0], len(self.x)
        start = np.clip(np.searchsorted(values, q[:, 0]) - self.k, 0, max(n - 2 * self.k, 0))
        at = start[:, None] + np.arange(min(2 * self.k, n))[None, :]
        diff = q - values[at]
        return kth_sum(diff * diff, self.k)

    def _tree(self, q: np.ndarray) -> np.ndarray:
        node = np.zeros(len(q), dtype=int)
        while self.first_leaf and node[0] < self.first_leaf:
            node = 2 * node + 1 + (q[np.arange(len(q)), self.dim[node]] > self.cut[node])
        best = np.full((len(q), self.k), FAR * FAR)

        def look(leaf: int, who: np.ndarray) -> None:
            s, e = self.bounds[leaf]
            both = np.hstack([best[who], capped(squared_distances(q[who], self.x[s:e]))])
            best[who] = np.partition(both, self.k - 1, axis=1)[:, : self.k]

        order = np.argsort(node, kind="stable")
        for who in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
            look(node[who[0]], who)
        ways = [(0, np.arange(len(q)))]
        while ways:
            at, who = ways.pop()
            if at >= self.first_leaf:
                who = who[node[who] != at]
            apart = np.maximum(np.maximum(self.lo[at] - q[who], q[who] - self.hi[at]), 0.0)
            who = who[(apart * apart).sum(axis=1) * HAIR <= best[who].max(axis=1)]
            if not len(who):
                continue
            if at >= self.first_leaf:
                look(at, who)
            else:
                ways += [(2 * at + 1, who), (2 * at + 2, who)]
        return best.sum(axis=1)


def kth_sum(d2: np.ndarray, k: int) -> np.ndarray:
    """Sum of each row's k smallest entries, short rows filled up with FAR squared."""
    d2 = capped(d2)
    if d2.shape[1] < k:
        d2 = np.hstack([d2, np.full((len(d2), k - d2.shape[1]), FAR * FAR)])
    return np.partition(d2, k - 1, axis=1)[:, :k].sum(axis=1)


def score_by_broadcast(df: DataFrame, features: list[str], matrix: np.ndarray, k: int, extent: int, mean_ev: float, max_nplof: float) -> DataFrame:
    """Batch or streaming DataFrame with ``score``; the matrix must be within BROADCAST_BYTES."""
    if matrix.nbytes > BROADCAST_BYTES:
        raise ValidationError(f"{matrix.nbytes} bytes of training points are over the broadcast bound; score a batch instead")
    shared = df.sparkSession.sparkContext.broadcast(Near(matrix, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # the columns given pass as they are
            x = np.column_stack([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in features])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.sums(x))], names=[*b.schema.names, SSD])

    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return finish(df.mapInArrow(run, f"{cols}, {SSD} double"), k, extent, mean_ev, max_nplof)


TWO = "block long, cluster string, nq int, np int, qs array<double>, ps array<double>, qlo array<double>, qhi array<double>, plo array<double>, phi array<double>, kth array<double>, reach double"


def _pack_two(width: int, k: int, block: int):
    """Blocks of rows in spatial order, new ones (is_new) and points apart, with a bound of each new row's k-th distance.

    The bound comes from the points of the block and the last ones before it; infinite where those are fewer than k.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, seq = TaskContext.get().partitionId() << 33, 0
        before, held = np.zeros((0, width)), np.zeros((0, width + 1))
        for f in knn._with_end(frames):
            if f is not None:
                held = np.vstack([held, f.to_numpy(dtype=float)])
            whole = len(held) if f is None else len(held) // block * block
            out = []
            for at in range(0, whole, block):
                part = held[at : min(at + block, whole)]
                q, p = part[part[:, 0] == 1, 1:], part[part[:, 0] == 0, 1:]
                near = np.vstack([before, p])
                kth = np.partition(squared_distances(q, near), k - 1, axis=1)[:, k - 1] if len(near) >= k else np.full(len(q), np.inf)
                box = [b for x in (q, p) for b in ((x.min(axis=0), x.max(axis=0)) if len(x) else (None, None))]
                out.append((base | seq, "0", len(q), len(p), q.ravel(), p.ravel(), *box, kth, float(kth.max()) if len(q) else 0.0))
                before, seq = near[-4 * k :], seq + 1
            held = held[whole:]
            if out:
                yield pd.DataFrame(out, columns=["block", "cluster", "nq", "np", "qs", "ps", "qlo", "qhi", "plo", "phi", "kth", "reach"])
    return run


def score_by_blocks(df: DataFrame, features: list[str], points: DataFrame, feats: list[str], k: int, extent: int, mean_ev: float, max_nplof: float, block: int = 1024) -> DataFrame:
    """A batch with ``score`` against training points of any number, exactly.

    New rows and points are dealt together by a space-filling key, so that a block of new rows has points beside
    it that bound its k-th distances; it then visits only the blocks of points whose box is within that bound.
    Equal new rows are searched once. A value that is missing or not finite is far from every point.
    """
    def values(names: list[str]):
        return F.array(*[F.col(f"`{c}`").cast("double") for c in names])

    finite = F.forall("_fp_x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    names = [f"f{i}" for i in range(len(feats))]
    spread = [F.col("_fp_x")[i].alias(c) for i, c in enumerate(names)]
    new = df.select(values(features).alias("_fp_x")).filter(finite).distinct().select(F.lit(1.0).alias("is_new"), F.lit(0).cast("long").alias("_h"), *spread)
    old = points.select(values(feats).alias("_fp_x"), F.xxhash64("id").alias("_h")).filter(finite)
    of_equal = F.row_number().over(Window.partitionBy("_fp_x").orderBy("_h"))  # k of equal points are enough
    old = old.withColumn("_n", of_equal).filter(F.col("_n") <= k).select(F.lit(0.0).alias("is_new"), "_h", *spread).persist()
    parts = max(2, min(old.count() // (4 * block) + 1, 20_000))
    keyed = knn._spatial_key(new.unionByName(old), names)
    dealt = keyed.repartitionByRange(parts, "_key", "_h").sortWithinPartitions("_key", "_h")
    both = dealt.select("is_new", *names).mapInPandas(_pack_two(len(names), k, block), TWO).persist()
    asking = both.filter("nq > 0").select("block", "cluster", F.col("qlo").alias("lo"), F.col("qhi").alias("hi"), "reach")
    asked = both.filter("np > 0").select("block", "cluster", F.col("plo").alias("lo"), F.col("phi").alias("hi"), F.lit(0.0).alias("reach"))
    pairs = knn._close(asking, parts, len(names), asked, "euclidean", both.count())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                x, y = np.asarray(r.qs).reshape(r.nq, -1), np.asarray(r.ps).reshape(r.np, -1)
                d2 = squared_distances(x, y)
                row, col = knn.smallest(d2, np.arange(r.np), k, np.asarray(r.kth))
                if len(row):
                    yield pd.DataFrame({"_x": list(x[row]), "d2": d2[row, col]})

    work = pairs.join(both.select("block", "nq", "qs", "kth"), "block").join(both.select(F.col("block").alias("other"), "np", "ps"), "other")
    near = work.select("nq", "qs", "kth", "np", "ps").mapInPandas(run, "_x array<double>, d2 double")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("_x").orderBy("d2"))).filter(F.col("r") <= k)
    ssd = best.groupBy("_x").agg((F.sum(F.least("d2", F.lit(FAR * FAR))) + (k - F.count(F.lit(1))) * (FAR * FAR)).alias(SSD))
    joined = df.withColumn("_fp_x", values(features)).join(ssd, F.col("_fp_x") == F.col("_x"), "left").drop("_fp_x", "_x")
    return finish(joined.withColumn(SSD, F.coalesce(SSD, F.lit(k * FAR * FAR))), k, extent, mean_ev, max_nplof)


def score_distances(df: DataFrame, dist: str, k: int, extent: int, mean_ev: float, max_nplof: float) -> DataFrame:
    """Matrix mode: one distance per row stands for all k neighbours; no join."""
    d = F.least(F.nanvl(F.coalesce(F.col(dist).cast("double"), F.lit(FAR)), F.lit(FAR)), F.lit(FAR))
    return finish(df.withColumn(SSD, d * d * float(k)), k, extent, mean_ev, max_nplof)


def refit_each_batch(stream: DataFrame, estimator, on_model, checkpoint: str):
    """foreachBatch sink: fits the estimator on each micro-batch and hands the model on."""
    return stream.writeStream.foreachBatch(lambda df, epoch: on_model(estimator.fit(df), epoch)).option("checkpointLocation", checkpoint)
