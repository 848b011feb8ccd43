"""k-nearest-neighbour self-join within clusters: (id, cluster, nid, d2, rank).

Order is total: by squared distance, then by neighbour id. Two exact strategies:

``sql``    equi-join on the cluster, top-k by window. Catalyst plans a group limit before
           and after the exchange. The probe side is repartitioned by id, else the pairs of
           a small file would be built in a single task.
``block``  equal points have the same neighbours but for themselves: of each distinct point the
           k + 1 smallest ids stay, and its k + 1 nearest, itself among them, are searched once.
           Points are dealt by a space-filling key into blocks of bounded size. Each block finds
           the neighbours among its own rows, which bounds every point's last distance; a block
           then visits only those blocks whose bounding box can hold something nearer. A hot
           cluster is many blocks, never one task; a task holds two blocks at a time. Pairs of
           blocks are found from the top of a tree of boxes down, by equi-joins on the parents.
           Hamming distances have few values, and boxes bound them badly: for up to
           HAMMING_FEATURES features the smallest ids that agree in each set of features are enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farpoint.functions import kernels
from farpoint.functions.metrics import METRICS, distance_sql, euclidean_sq
from farpoint.operators.validate import feature_names

#: Above so many pairs the block strategy is used.
SQL_PAIRS = 5_000_000
#: An unrolled distance over more features outgrows what the JVM compiles.
WIDE_FEATURES = 16
#: Rows of a block; a task holds two blocks and a matrix of BLOCK x BLOCK doubles. Few features prune well: smaller blocks.
BLOCK, SMALL_BLOCK, FEW_FEATURES = 1024, 512, 4
#: Up to so many features, Hamming neighbours come from the sets of features: 2 to that power joins.
HAMMING_FEATURES = 4
#: Boxes under one box of the tree.
FAN = 32
#: Numbers compared by the driver to find pairs of few boxes, in place of the tree's joins.
FEW_COMPARED, AT_ONCE = 200_000_000, 4_000_000
PACKED = "block long, cluster string, n int, ids array<{id}>, firsts array<boolean>, xs array<double>, lo array<double>, hi array<double>"


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest per id of (id, cluster, nid, d2), with rank from 1."""
    w = Window.partitionBy("id").orderBy("d2", "nid")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def sql_edges(points: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """All pairs of a cluster by equi-join, then top-k. d2 is the squared distance."""
    feats = feature_names(points)
    n = max(points.sparkSession.sparkContext.defaultParallelism * 2, 8)
    a = points.repartition(n, "id").alias("a")
    b = points.alias("b")
    left, right = [f"a.{c}" for c in feats], [f"b.{c}" for c in feats]
    if metric == "euclidean":
        d2 = F.expr(euclidean_sq(left, right))
    else:
        d = F.expr(distance_sql(metric, left, right))
        d2 = d * d
    pairs = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.id") != F.col("b.id")))
    return top_k(pairs.select(F.col("a.id").alias("id"), F.col("a.cluster").alias("cluster"), F.col("b.id").alias("nid"), d2.alias("d2")), k)


def smallest(d2: np.ndarray, ids: np.ndarray, k: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k smallest by (d2, id); infinite and over-limit entries never count."""
    m = d2.shape[1]
    row = col = None
    if limit is not None:
        near = d2 <= limit[:, None]
        if near.sum() <= 4 * k * len(d2):
            row, col = np.nonzero(near & np.isfinite(d2))
    if row is None:
        kth = np.partition(d2, k - 1, axis=1)[:, k - 1] if m > k else np.full(len(d2), np.inf)
        if limit is not None:
            kth = np.minimum(kth, limit)
        row, col = np.nonzero((d2 <= kth[:, None]) & np.isfinite(d2))
    return _ranked(row, d2[row, col], ids[col], k, col)


def _ranked(row: np.ndarray, d2: np.ndarray, ids: np.ndarray, k: int, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, *more) in the order of (row, d2, id), the first k of each row."""
    place = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
    order = np.lexsort((place, d2, row))
    row = row[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], *[x[order][keep] for x in more]


def _spatial_key(points: DataFrame, feats: list[str], metric: str = "euclidean") -> DataFrame:
    """Adds ``_key``: the value itself for one feature, else interleaved bits of up to four scaled features."""
    if len(feats) == 1:
        return points.withColumn("_key", F.col(feats[0]))
    used = {c: F.col(c) for c in feats[:4]}
    if metric == "cosine":
        norm = F.sqrt(sum((F.col(c) * F.col(c) for c in feats[1:]), F.col(feats[0]) * F.col(feats[0])))
        used = {c: F.when(norm > 0, x / F.when(norm > 0, norm).otherwise(1.0)).otherwise(0.0) for c, x in used.items()}
    r = points.agg(*[f(x) for x in used.values() for f in (F.min, F.max)]).first()
    bits = 60 // len(used)
    parts = []
    for i, x in enumerate(used.values()):
        lo, hi = r[2 * i], r[2 * i + 1]
        wide = lo is not None and hi > lo and np.isfinite(hi - lo)
        parts.append(((x - lo) / (hi - lo) * (2**bits - 1)).cast("long") if wide else F.lit(0).cast("long"))
    cells = [f"_c{i}" for i in range(len(parts))]
    key = F.lit(0).cast("long")
    for bit in range(bits):
        for i, c in enumerate(cells):
            key = key + F.shiftleft(F.shiftright(c, bit).bitwiseAND(1), bit * len(parts) + i)
    return points.withColumns(dict(zip(cells, parts, strict=True))).withColumn("_key", key).drop(*cells)


def _pack(feats: list[str], block: int, metric: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seq, rest = TaskContext.get().partitionId(), 0, None
        for f in _with_end(frames):
            f = rest if f is None else f if rest is None else pd.concat([rest, f], ignore_index=True)
            if f is None or not len(f):
                continue
            last = f is rest
            out, rest = [], None
            edges = np.flatnonzero(f["cluster"].to_numpy()[1:] != f["cluster"].to_numpy()[:-1]) + 1
            for s, e in zip([0, *edges], [*edges, len(f)], strict=True):
                for lo in range(s, e, block):
                    hi = min(lo + block, e)
                    if hi == len(f) and not last:  # may go on in the next batch
                        rest = f.iloc[lo:].reset_index(drop=True)
                        break
                    g = f.iloc[lo:hi]
                    x = g[feats].to_numpy(dtype=float)
                    in_space = kernels.space(metric, x)
                    out.append((part << 33 | seq, g["cluster"].iloc[0], hi - lo, g["id"].to_numpy(), g["first"].to_numpy(), x.ravel(), in_space.min(axis=0), in_space.max(axis=0)))
                    seq += 1
            if out:
                yield pd.DataFrame(out, columns=["block", "cluster", "n", "ids", "firsts", "xs", "lo", "hi"])
    return run


def _with_end(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from frames
    yield None


def _local(k: int, metric: str):
    """Adds the largest k-th distance of a first row within its block, which counts itself; below 0 where no row is a first."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            reach = []
            for n, xs, firsts in zip(f["n"], f["xs"], f["firsts"], strict=True):
                x = np.asarray(xs).reshape(n, -1)
                d2 = kernels.squared(metric, x[np.asarray(firsts, dtype=bool)], x)
                kth = np.partition(d2, k - 1, axis=1)[:, k - 1] if n >= k else np.full(len(d2), np.inf)
                reach.append(float(kth.max()) if len(kth) else -1.0)
            yield f.assign(reach=reach)
    return run


def _gap(lo: str, hi: str, olo: str, ohi: str):
    """Squared distance of two boxes; a hair's breadth less, as boxes and kernel round differently."""
    return F.expr(
        f"aggregate(transform({lo}, (l, i) -> greatest(l - {ohi}[i], {olo}[i] - {hi}[i], 0D)), 0D, (s, g) -> s + g * g)"
    ) * (1 - 1e-12)


def _gap_by(metric: str):
    """_gap for any metric but the Euclidean one."""
    @F.pandas_udf("double")
    def bound(lo: pd.Series, hi: pd.Series, olo: pd.Series, ohi: pd.Series) -> pd.Series:
        return pd.Series(kernels.gap(metric, *[np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1)) for x in (lo, hi, olo, ohi)]))

    return bound


def _close(boxes: DataFrame, parts: int, width: int, others: DataFrame | None = None, metric: str = "euclidean", count: int | None = None) -> DataFrame:
    """(block, other): blocks of a cluster whose boxes are within the first one's reach.

    boxes: block, cluster, lo, hi, reach; others, where given, hold the second blocks; count is their number, where
    it is known: a few are compared at once, by the driver. Blocks of one partition are neighbours in space, and so are
    FAN partitions in a row, and so on: boxes of each level hold those of the next. Two boxes are only
    looked at where their parents are within reach.
    """
    if count is not None and count * count * width <= FEW_COMPARED:
        return _close_few(boxes, others, metric)
    gap = _gap if metric == "euclidean" else _gap_by(metric)
    levels = 1
    while FAN**levels < parts:
        levels += 1
    part = F.shiftright("block", 33)

    def tree(lowest: DataFrame) -> list[DataFrame]:
        tables = [lowest.withColumns({"key": F.col("block"), "up": part})]
        for _ in range(levels + 1):
            low = [F.min(F.col("lo")[i]) for i in range(width)]
            high = [F.max(F.col("hi")[i]) for i in range(width)]
            grouped = tables[-1].groupBy("cluster", F.col("up").alias("key")).agg(F.array(*low).alias("lo"), F.array(*high).alias("hi"), F.max("reach").alias("reach"))
            tables.append(grouped.withColumn("up", F.floor(F.col("key") / FAN)))
        return tables

    first = tree(boxes)
    second = first if others is None else tree(others)
    columns = lambda t, side: t.select(*[F.col(c).alias(f"{side}_{c}") for c in ("cluster", "key", "up", "lo", "hi", "reach")])

    def descend(pairs: DataFrame, level: tuple[DataFrame, DataFrame]) -> DataFrame:
        a = pairs.join(columns(level[0], "a"), (F.col("cluster") == F.col("a_cluster")) & (F.col("x") == F.col("a_up")))
        both = a.join(columns(level[1], "b"), (F.col("cluster") == F.col("b_cluster")) & (F.col("y") == F.col("b_up")))
        return both.filter(gap("a_lo", "a_hi", "b_lo", "b_hi") <= F.col("a_reach")).select("cluster", F.col("a_key").alias("x"), F.col("b_key").alias("y"))

    top = first[-1].select("cluster", F.col("key").alias("x"), F.col("key").alias("y"))  # one box a cluster, its key 0 in both
    return reduce(descend, list(zip(first, second, strict=True))[-2::-1], top).select(F.col("x").alias("block"), F.col("y").alias("other"))


def _close_few(boxes: DataFrame, others: DataFrame | None, metric: str) -> DataFrame:
    first = boxes.select("block", "cluster", "lo", "hi", "reach").toPandas()
    second = first if others is None else others.select("block", "cluster", "lo", "hi").toPandas()
    found = []
    by = dict(list(second.groupby("cluster")))
    for cluster, mine in first.groupby("cluster"):
        if cluster not in by:
            continue
        lo, hi = (np.stack(by[cluster][c].to_numpy()) for c in ("lo", "hi"))
        step = max(1, AT_ONCE // lo.size)
        for i in range(0, len(mine), step):
            part = mine.iloc[i : i + step]
            low, high = (np.stack(part[c].to_numpy())[:, None, :] for c in ("lo", "hi"))
            x, y = np.nonzero(kernels.gap(metric, low, high, lo[None], hi[None]) <= part["reach"].to_numpy()[:, None])
            found.append(pd.DataFrame({"block": part["block"].to_numpy()[x], "other": by[cluster]["block"].to_numpy()[y]}))
    pairs = pd.concat(found, ignore_index=True) if found else pd.DataFrame({"block": [], "other": []}, dtype="int64")
    table = pa.Table.from_pandas(pairs, schema=pa.schema([("block", pa.int64()), ("other", pa.int64())]), preserve_index=False)
    return boxes.sparkSession.createDataFrame(table)


class _Home:
    """A block's first rows, and the nearest found for them so far."""

    def __init__(self, cluster: str, x: np.ndarray, ids: np.ndarray, firsts: np.ndarray, k: int, metric: str):
        self.cluster, self.x, self.k, self.metric = cluster, x[firsts], k, metric
        self.point = kernels.space(metric, self.x)
        self.row, self.d2, self.ids = np.zeros(0, dtype=int), np.zeros(0), ids[:0]
        self.kth = np.full(len(self.x), np.inf)
        self.take(np.arange(len(self.x)), x, ids)

    def take(self, at: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        if not len(at):
            return
        d2 = kernels.squared(self.metric, self.x[at], x)
        row, col = smallest(d2, ids, self.k, self.kth[at])
        if not len(row):
            return
        row, d2, ids = np.r_[self.row, at[row]], np.r_[self.d2, d2[row, col]], np.r_[self.ids, ids[col]]
        self.row, self.d2, self.ids = _ranked(row, d2, ids, self.k, d2, ids)
        ends = np.searchsorted(self.row, np.arange(len(self.x)), side="right")
        full = ends - np.searchsorted(self.row, np.arange(len(self.x))) == self.k
        self.kth[full] = self.d2[ends[full] - 1]

    def visit(self, x: np.ndarray, ids: np.ndarray) -> None:
        box = kernels.space(self.metric, x)
        near = kernels.gap(self.metric, self.point, self.point, box.min(axis=0), box.max(axis=0)) <= self.kth
        self.take(np.flatnonzero(near), x, ids)


def _numbers(column: pa.ListArray, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def _nearest(width: int, k: int, metric: str, schema: pa.Schema):
    """Rows of one block follow each other, its own rows (gap below 0) first, then blocks to visit; a row per distinct point comes out."""
    def out(homes: list[_Home]) -> pa.RecordBatch:
        x = np.vstack([h.x for h in homes])
        counts = np.concatenate([np.bincount(h.row, minlength=len(h.x)) for h in homes])
        offsets = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
        cluster = pa.array(np.repeat(np.array([h.cluster for h in homes], dtype=object), [len(h.x) for h in homes]), pa.string())
        ids = pa.array(np.concatenate([h.ids for h in homes]), schema.field("nids").type.value_type)
        lists = [pa.ListArray.from_arrays(offsets, v) for v in (ids, pa.array(np.concatenate([h.d2 for h in homes])))]
        return pa.RecordBatch.from_arrays([cluster, *[pa.array(x[:, i]) for i in range(width)], *lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, done = None, []
        for b in batches:
            block, gap, cluster, firsts, ids, xs = (b.column(c) for c in ("block", "gap", "cluster", "firsts", "ids", "xs"))
            for i in range(b.num_rows):
                x, names = _numbers(xs, i).reshape(-1, width), _numbers(ids, i)
                if gap[i].as_py() < 0:
                    done += [home] if home is not None else []
                    if sum(len(h.x) for h in done) >= 4096:
                        yield out(done)
                        done = []
                    home = _Home(cluster[i].as_py(), x, names, _numbers(firsts, i).astype(bool), k, metric)
                else:
                    home.visit(x, names)
        done += [home] if home is not None else []
        if done:
            yield out(done)
    return run


def _arrow_type(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))


def _by_blocks(kept: DataFrame, feats: list[str], k: int, rows: int, block: int, metric: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """The k nearest of each distinct point, itself among them, and the blocks that are held for them."""
    packed_kind = PACKED.format(id=kind)
    parts = max(2, min(rows // (4 * block) + 1, 20_000))
    dealt = _spatial_key(kept, feats, metric).repartitionByRange(parts, "cluster", "_key", *feats).sortWithinPartitions("cluster", "_key", *feats, "id")
    packed = dealt.select("id", "cluster", "first", *feats).mapInPandas(_pack(feats, block, metric), packed_kind)
    blocks = packed.mapInPandas(_local(k, metric), packed_kind + ", reach double").persist()
    held = blocks.count()
    pairs = _close(blocks.select("block", "cluster", "lo", "hi", "reach"), parts, len(feats), None, metric, held).filter("block <> other")
    gap = _gap if metric == "euclidean" else _gap_by(metric)
    own = blocks.filter("reach >= 0").select("block", F.lit(-1.0).alias("gap"), "cluster", "firsts", "ids", "xs")
    boxes = pairs.join(blocks.filter("reach >= 0").select("block", "lo", "hi"), "block")
    there = blocks.select(F.col("block").alias("other"), F.col("lo").alias("olo"), F.col("hi").alias("ohi"), "cluster", "firsts", "ids", "xs")
    visits = boxes.join(there, "other").select("block", gap("lo", "hi", "olo", "ohi").alias("gap"), "cluster", "firsts", "ids", "xs")
    tasks = max(min(held, 2 * kept.sparkSession.sparkContext.defaultParallelism), min(held // 16, 20_000), 1)
    work = own.unionByName(visits).repartition(tasks, "block").sortWithinPartitions("block", "gap")
    schema = pa.schema([("cluster", pa.string()), *[(c, pa.float64()) for c in feats], ("nids", pa.list_(_arrow_type(kind))), ("d2s", pa.list_(pa.float64()))])
    columns = "cluster string, " + ", ".join(f"{c} double" for c in feats) + f", nids array<{kind}>, d2s array<double>"
    return work.mapInArrow(_nearest(len(feats), k, metric, schema), columns), blocks


def _by_agreement(kept: DataFrame, feats: list[str], k: int) -> DataFrame:
    """The k nearest of each distinct point by Hamming distance, itself among them.

    Who differs in given features agrees in the others: of those that agree in a set of features, the k smallest
    ids, for every set, hold the nearest.
    """
    lists = []
    out = kept.filter("first").select("cluster", *feats)
    for n in range(len(feats) + 1):
        for some in combinations(feats, n):
            keys = ["cluster", *some]
            w = Window.partitionBy(*keys).orderBy("id")
            least = kept.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
            lists.append(f"_l{len(lists)}")
            out = out.join(least.groupBy(*keys).agg(F.collect_list(F.struct("id", F.array(*feats).alias("x"))).alias(lists[-1])), keys)
    own = F.array(*feats)

    def entry(e):
        d = F.aggregate(F.zip_with(e["x"], own, lambda a, b: F.when(a != b, 1.0).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v) / float(len(feats))
        return F.struct((d * d).alias("d2"), e["id"].alias("nid"))

    near = F.slice(F.array_sort(F.array_distinct(F.transform(F.concat(*lists), entry))), 1, k)
    return out.select("cluster", *feats, near.alias("_n")).select("cluster", *feats, F.col("_n.nid").alias("nids"), F.col("_n.d2").alias("d2s"))


def block_edges(points: DataFrame, k: int, rows: int, block: int | None = None, metric: str = "euclidean") -> DataFrame:
    """Exact neighbours by pruned block pairs. Ids and clusters keep their types; a row with a value that is not finite has none."""
    METRICS[metric]
    feats = feature_names(points)
    block = block or (SMALL_BLOCK if len(feats) <= FEW_FEATURES else BLOCK)
    kinds = dict(points.dtypes)
    inner = "long" if kinds["id"] in ("tinyint", "smallint", "int", "bigint") else kinds["id"]
    finite = reduce(lambda a, b: a & b, [F.abs(c) < float("inf") for c in feats])
    flat = points.select(F.col("id").cast(inner).alias("id"), F.col("cluster").cast("string").alias("cluster"), *[(F.col(c) + 0.0).alias(c) for c in feats])
    flat = flat.filter(finite & F.col("cluster").isNotNull())
    same = ["cluster", *feats] if len(feats) <= WIDE_FEATURES else ["cluster", F.array(*feats)]
    w = Window.partitionBy(*same).orderBy("id")
    kept = flat.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k + 1).withColumn("first", F.col("_n") == 1).drop("_n").persist()
    distinct = kept.count()
    if metric == "hamming" and len(feats) <= HAMMING_FEATURES:
        lists, held = _by_agreement(kept, feats, k + 1), [kept]
    else:
        lists, blocks = _by_blocks(kept, feats, k + 1, distinct, block, metric, inner)
        kept.unpersist()
        held = [blocks]
    if len(feats) <= WIDE_FEATURES:
        both = flat.join(lists, ["cluster", *feats])
    else:
        x = F.array(*feats)
        both = flat.select("id", "cluster", x.alias("_x")).join(lists.select("cluster", x.alias("_x"), "nids", "d2s"), ["cluster", "_x"])
    others = F.slice(F.filter(F.arrays_zip("nids", "d2s"), lambda e: e["nids"] != F.col("id")), 1, k)
    best = both.select("id", "cluster", F.posexplode(others).alias("_r", "_e"))
    out = best.select(
        F.col("id").cast(kinds["id"]).alias("id"), F.col("cluster").cast(kinds["cluster"]).alias("cluster"), F.col("_e.nids").cast(kinds["id"]).alias("nid"),
        F.col("_e.d2s").alias("d2"), (F.col("_r") + 1).alias("rank"))
    out._kept = held
    return out


def knn_edges(points: DataFrame, k: int, pairs: int, rows: int, strategy: str = "auto", metric: str = "euclidean") -> DataFrame:
    """Picks a strategy: blocks for many pairs or many features."""
    if strategy == "auto":
        strategy = "block" if pairs > SQL_PAIRS or len(feature_names(points)) > WIDE_FEATURES else "sql"
    return block_edges(points, k, rows, metric=metric) if strategy == "block" else sql_edges(points, k, metric)
