"""Exact top-k inner-product search by best-first traversal of M-trees.

Vectors are dealt to the nearest of a sample of pivots, and each pivot's vectors into pages of
bounded size, so a hot vector or cluster is many pages. A page is an M-tree: leaves of ``LEAF`` vectors
under routing nodes, each with its centre, covering radius and distance to its parent's centre.
A block of queries meets a page in one task row and goes through the tree together, the node with
the best bound first: a query first bounds a node through the stored parent distance, by the triangle
inequality, and computes its own distance to the centre only where that bound could still beat its
k-th score; at a leaf only the queries are scored that it could still serve.

Above the pages stand two more levels, of the same kind: cells, at most ``PIVOT_SAMPLE``, and under
them directories of at most ``DIRECTORY`` pages, each page with its ball and its distance to the
cell's pivot. A block of queries, with the scores from its own page to beat, goes to the cells
whose ball could hold more, by an equi-join to their directories, and on, again by an equi-join,
to the pages left there. No two tables are paired without a key.

For vectors of any norms, q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2 turns a bound on the distance
into one on the score. Scores themselves are integers, computed exactly.

Components x become floor(scale * x). Cases: null vectors and those with a null or non-finite
component, or one that scale makes infinite, take no part; shorter vectors are padded with zeros; scores
are exact at any size, and those beyond a long count as the nearest long; repeated rows are ranked each,
except those with the query's own id (every row of that id is the query's own); ties go to the smaller
id; rows with a null id take no part. A query is an id with a vector (after scaling): repeated query
rows are one query, and an id with several vectors has ranks 1 to k for each of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farpoint.llm.common import checkpoint, ship

#: Vectors of a page, queries of a block, vectors of a leaf, children of a node.
PAGE, QUERIES, LEAF, FAN = 4096, 256, 64, 8
#: Vectors from which pivots are drawn; the sample decides only how vectors are dealt.
PIVOT_SAMPLE = 256
#: Pages of a directory.
DIRECTORY = 256
#: No score is lower; as a floor it means that none is known.
LOWEST = -(1 << 63)
#: Slack of the bounds for rounding of square roots, relative and absolute.
SLACK = 1e-9


def quantise(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(x * scale)


def whole(x: np.ndarray) -> np.ndarray:
    """Integers of any size."""
    return np.array([int(v) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of q and x: in doubles below 2^53, in longs below 2^63, else in integers of any size."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    if most < 2.0**53:
        return (q @ x.T).astype(np.int64)
    if most < 2.0**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    return np.clip(whole(q) @ whole(x).T, LOWEST, -LOWEST - 1).astype(np.int64)


def most_score(qq: np.ndarray, d: np.ndarray, radius, top) -> np.ndarray:
    """No score in a ball at distance d, with squared norms of at most ``top``, is higher."""
    with np.errstate(over="ignore", invalid="ignore"):
        low = np.maximum(0.0, d - radius)
        out = (qq + top - low * low) / 2 + SLACK * (qq + top) + SLACK
    return np.where(np.isnan(out), np.inf, out)  # beyond doubles nothing is known


class Best:
    """The k best (score, id) of each query of a block so far, best first, and what a further score must reach."""

    def __init__(self, own: np.ndarray, k: int, floors: np.ndarray):
        self.own, self.k, self.floors = own, k, floors
        self.scores = np.full((len(own), k), LOWEST, dtype=np.int64)
        self.ids = np.zeros((len(own), k), dtype=np.int64)
        self.held = np.zeros(len(own), dtype=np.int64)
        self.bar = floors.copy()

    def add(self, some: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries ``some`` (rows) for ``ids`` (columns)."""
        ok = (scores >= self.bar[some, None]) & (ids[None, :] != self.own[some, None])
        hit = np.flatnonzero(ok.any(axis=1))
        if not len(hit):
            return
        cols = np.flatnonzero(ok.any(axis=0))
        at, ok, more = some[hit], ok[np.ix_(hit, cols)], scores[np.ix_(hit, cols)]
        there = np.concatenate([np.arange(self.k)[None, :] < self.held[at, None], ok], axis=1)
        s = np.concatenate([self.scores[at], more], axis=1)
        i = np.concatenate([self.ids[at], np.broadcast_to(ids[cols], more.shape)], axis=1)
        # least id first, then the highest score, then what is there at all
        for key in (lambda: i, lambda: ~s, lambda: ~there):
            order = np.argsort(key(), axis=1, kind="stable")
            s, i, there = (np.take_along_axis(v, order, axis=1) for v in (s, i, there))
        self.scores[at], self.ids[at] = s[:, : self.k], i[:, : self.k]
        self.held[at] = np.minimum(there.sum(axis=1), self.k)
        full = at[self.held[at] == self.k]
        self.bar[full] = np.maximum(self.floors[full], self.scores[full, -1])


def apart(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - centre) ** 2).sum(axis=1))


class MTree:
    """Bulk-loaded over one page: rows are split by the farther of two distant members until leaves are small."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.norm2 = (x * x).sum(axis=1)
        self.root = self._build(np.arange(len(ids)), None)

    def _build(self, rows: np.ndarray, parent: np.ndarray | None) -> dict:
        sub = self.x[rows]
        centre = sub.mean(axis=0)
        d = np.sqrt(((sub - centre) ** 2).sum(axis=1))
        node = {"centre": centre, "radius": float(d.max()), "parent": 0.0 if parent is None else float(np.sqrt(((centre - parent) ** 2).sum())), "top": float(self.norm2[rows].max())}
        if len(rows) <= LEAF:
            node["rows"] = rows
            return node
        groups = [rows]
        while len(groups) < FAN:
            g = max(groups, key=len)
            if len(g) <= LEAF // 2:
                break
            groups = [h for h in groups if h is not g] + self._halve(g)
        node["children"] = kids = [self._build(g, centre) for g in groups if len(g)]
        for name in ("radius", "parent", "top"):
            node[f"k_{name}"] = np.array([c[name] for c in kids])
        return node

    def _halve(self, rows: np.ndarray) -> list[np.ndarray]:
        sub = self.x[rows]
        a = sub[((sub - sub[0]) ** 2).sum(axis=1).argmax()]
        da = ((sub - a) ** 2).sum(axis=1)
        b = sub[da.argmax()]
        side = np.argsort(da - ((sub - b) ** 2).sum(axis=1), kind="stable")
        half = len(rows) // 2
        return [rows[side[:half]], rows[side[half:]]]

    def search(self, q: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray) -> Best:
        """Best rows per query, of those with a score of at least its floor, without its own id."""
        qq, best = (q * q).sum(axis=1), Best(own, k, floors)
        d0 = apart(q, self.root["centre"])
        queue = [(-np.inf, 0, self.root, np.arange(len(q)), d0, most_score(qq, d0, self.root["radius"], self.root["top"]))]
        serial = 0
        while queue:
            _, _, node, some, d, bound = heapq.heappop(queue)
            left = bound >= best.bar[some]
            some, d = some[left], d[left]
            if not len(some):
                continue
            if "rows" in node:
                best.add(some, exact_products(q[some], self.x[node["rows"]]), self.ids[node["rows"]])
                continue
            # by the parent distance alone, without looking at the child's centre
            near = most_score(qq[some][:, None], np.abs(d[:, None] - node["k_parent"]), node["k_radius"], node["k_top"]) >= best.bar[some][:, None]
            for c, kid in enumerate(node["children"]):
                mine = some[near[:, c]]
                if len(mine):
                    dist = apart(q[mine], kid["centre"])
                    b = most_score(qq[mine], dist, kid["radius"], kid["top"])
                    ok = b >= best.bar[mine]
                    if ok.any():
                        serial += 1
                        heapq.heappush(queue, (-float(b[ok].max()), serial, kid, mine[ok], dist[ok], b[ok]))
        return best


_TREES: dict[tuple, MTree] = {}


def tree_of(page: int, ids: bytes, x: bytes, width: int) -> MTree:
    """The tree of a page; the last few stay, as a task meets a page with many query blocks."""
    key = (page, len(ids), hash(ids))
    if key not in _TREES:
        if len(_TREES) >= 4:
            _TREES.pop(next(iter(_TREES)))
        _TREES[key] = MTree(np.frombuffer(ids, dtype=np.int64), np.frombuffer(x, dtype=np.float64).reshape(-1, width).copy())
    return _TREES[key]


def _matrix(vectors: pd.Series, width: int, scale: float) -> np.ndarray:
    x = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    return quantise(x, scale)


def _pack(width: int, scale: float, pivots: np.ndarray):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf["v"], width, scale)
        order = np.argsort(pdf["id"].to_numpy(), kind="stable")
        page, c = int(pdf["page"].iloc[0]), x.mean(axis=0)
        pivot = pivots[page >> 32]
        out = {"page": page, "ids": pdf["id"].to_numpy(np.int64)[order].tobytes(), "xs": x[order].tobytes(), "centre": c.tobytes(), "radius": float(apart(x, c).max()),
               "top": float((x * x).sum(axis=1).max()), "up": float(apart(c[None, :], pivot)[0]), "reach": float(apart(x, pivot).max())}
        return pd.DataFrame({k: [v] for k, v in out.items()})
    return run


PAGES = "page long, ids binary, xs binary, centre binary, radius double, top double, up double, reach double"


def _gather(pdf: pd.DataFrame) -> pd.DataFrame:
    """A directory: its pages' centres, radii, greatest squared norms and distances to the pivot."""
    out = {"dir": pdf["dir"].iloc[0], "members": pdf["page"].to_numpy(np.int64).tobytes(), "centres": b"".join(pdf["centre"])}
    out |= {c: pdf[c].to_numpy(np.float64).tobytes() for c in ("radius", "top", "up")}
    return pd.DataFrame({k: [v] for k, v in out.items()})


DIRECTORIES = "dir long, members binary, centres binary, radius binary, top binary, up binary"


def _search(width: int, k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                t = tree_of(r.page, r.ids, r.xs, width)
                qids, keys, q = np.frombuffer(r.qids, dtype=np.int64), np.frombuffer(r.qkeys, dtype=np.int64), np.frombuffer(r.qxs, dtype=np.float64).reshape(-1, width)
                found = t.search(q, qids, k, np.frombuffer(r.floors, dtype=np.int64))
                if found.held.any():
                    rows, at = np.nonzero(np.arange(k)[None, :] < found.held[:, None])
                    yield pd.DataFrame({"query_id": qids[rows], "qkey": keys[rows], "vec_id": found.ids[rows, at], "score": found.scores[rows, at]})
    return run


HITS = "query_id long, qkey long, vec_id long, score long"


def _blocks(width: int, scale: float):
    """Query rows of a page as one block, with floors (the lowest long where unknown)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "key"], kind="stable")
        x = _matrix(pdf["v"], width, scale)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "home": [pdf["page"].iloc[0]], "qids": [pdf["id"].to_numpy(np.int64).tobytes()], "qkeys": [pdf["key"].to_numpy(np.int64).tobytes()], "qxs": [x.tobytes()], "floors": [pdf["floor"].to_numpy(np.int64).tobytes()]})
    return run


BLOCKS = "block string, home long, qids binary, qkeys binary, qxs binary, floors binary"


def _enter(width: int, pivots: np.ndarray, cells: list[tuple[int, int, float, float]]):
    """The queries of a block that a cell's ball can serve, once for each of the cell's directories."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                ids, keys, q, floors = np.frombuffer(r.qids, dtype=np.int64), np.frombuffer(r.qkeys, dtype=np.int64), np.frombuffer(r.qxs, dtype=np.float64).reshape(-1, width), np.frombuffer(r.floors, dtype=np.int64)
                qq = (q * q).sum(axis=1)
                for cell, directories, reach, top in cells:
                    d = apart(q, pivots[cell])
                    keep = most_score(qq, d, reach, top) >= floors
                    if keep.any():
                        some = (ids[keep].tobytes(), keys[keep].tobytes(), q[keep].tobytes(), floors[keep].tobytes(), d[keep].tobytes())
                        yield pd.DataFrame([((cell << 32) + i, r.home, *some) for i in range(directories)], columns=["dir", "home", "qids", "qkeys", "qxs", "floors", "away"])
    return run


ENTRIES = "dir long, home long, qids binary, qkeys binary, qxs binary, floors binary, away binary"


def _descend(width: int):
    """The queries that a page of the directory can serve: by the stored distances first, then by their own."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                ids, keys, q, floors, away = np.frombuffer(r.qids, dtype=np.int64), np.frombuffer(r.qkeys, dtype=np.int64), np.frombuffer(r.qxs, dtype=np.float64).reshape(-1, width), np.frombuffer(r.floors, dtype=np.int64), np.frombuffer(r.away, dtype=np.float64)
                pages, centres = np.frombuffer(r.members, dtype=np.int64), np.frombuffer(r.centres, dtype=np.float64).reshape(-1, width)
                radius, top, up = (np.frombuffer(x, dtype=np.float64) for x in (r.radius, r.top, r.up))
                qq, out = (q * q).sum(axis=1), []
                for i, page in enumerate(pages.tolist()):
                    if page == r.home:
                        continue
                    near = np.flatnonzero(most_score(qq, np.abs(away - up[i]), radius[i], top[i]) >= floors)
                    near = near[most_score(qq[near], apart(q[near], centres[i]), radius[i], top[i]) >= floors[near]]
                    if len(near):
                        out.append((page, ids[near].tobytes(), keys[near].tobytes(), q[near].tobytes(), floors[near].tobytes()))
                if out:
                    yield pd.DataFrame(out, columns=["page", "qids", "qkeys", "qxs", "floors"])
    return run


def best_of(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", modulus: int = 20, k: int = 20, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by ``modulus`` and each of its vectors, the k best other rows."""
    spark = df.sparkSession
    ship(spark)
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) != float("inf")))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null").filter(fine)
    shape = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n, width = int(shape[0]), max(1, int(shape[1] or 1))
    pivots = max(1, min(PIVOT_SAMPLE, n // PAGE + 1))
    chosen = [list(r["v"]) + [0.0] * (width - len(r["v"])) for r in rows.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()]

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = np.array(chosen)
        for f in frames:
            x = np.zeros((len(f), width))
            for i, vec in enumerate(f["v"]):
                x[i, : len(vec)] = vec
            near = ((p * p).sum(axis=1)[None, :] - 2 * (np.clip(x, -1e100, 1e100) @ np.clip(p, -1e100, 1e100).T)).argmin(axis=1) if len(p) else np.zeros(len(f), dtype=np.int64)
            yield f.assign(cell=near.astype(np.int64))

    dealt = rows.mapInPandas(deal, "id long, v array<double>, cell long")
    dealt = checkpoint(dealt)
    sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("members"))  # at most PIVOT_SAMPLE rows
    placed = dealt.join(F.broadcast(sizes), "cell").withColumn("pages", F.ceil(F.col("members") / PAGE)).withColumn(
        "page", F.col("cell") * F.lit(1 << 32) + F.pmod(F.xxhash64("id"), "pages"))
    centres = quantise(np.array(chosen).reshape(-1, width) if chosen else np.zeros((1, width)), scale)
    pages = checkpoint(placed.select("id", "v", "page").groupBy("page").applyInPandas(_pack(width, scale, centres), PAGES))
    # beyond 2^53 a double has no fraction left
    floored = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    scaled = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: floored(F.coalesce(F.get("v", i), F.lit(0.0)) * scale))
    queries = checkpoint(placed.filter(F.col("id") % modulus == 0).withColumn("key", F.xxhash64(scaled)).dropDuplicates(["id", "key"]))
    part = F.pmod(F.xxhash64("id", "key", F.lit(1)), F.greatest(F.lit(1), F.ceil(F.col("members") / F.col("pages") / modulus / QUERIES)))
    block = F.concat_ws(":", "page", part)
    own = queries.select("id", "key", "v", "page", block.alias("block"), F.lit(LOWEST).alias("floor"))
    blocks = own.groupBy("block").applyInPandas(_blocks(width, scale), BLOCKS)
    home = checkpoint(blocks.join(pages, F.col("home") == F.col("page")).select("page", "ids", "xs", "qids", "qkeys", "qxs", "floors").mapInPandas(_search(width, k), HITS))
    # the k-th score at home is what other pages must reach
    kth = home.groupBy("query_id", "qkey").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("s"))
    floor = F.when(F.col("c") >= k, F.col("s")).otherwise(LOWEST)
    known = queries.select("id", "key", "v", "page", block.alias("block")).join(kth, (F.col("id") == F.col("query_id")) & (F.col("key") == F.col("qkey")), "left").withColumn("floor", F.coalesce(floor, F.lit(LOWEST)))
    known = checkpoint(known.select("id", "key", "v", "page", "block", "floor").groupBy("block").applyInPandas(_blocks(width, scale), BLOCKS))
    # at most PIVOT_SAMPLE cells, and from them by keys to directories and pages
    number = F.col("page").bitwiseAND(F.lit((1 << 32) - 1))
    listed = pages.drop("ids", "xs").withColumns({"cell": F.shiftright("page", 32), "number": F.floor(number / DIRECTORY)})
    directories = listed.withColumn("dir", F.col("cell") * F.lit(1 << 32) + F.col("number")).groupBy("dir").applyInPandas(_gather, DIRECTORIES)
    cells = [(int(r["cell"]), int(r["n"]), r["reach"], r["top"]) for r in listed.groupBy("cell").agg((F.max("number") + 1).alias("n"), F.max("reach").alias("reach"), F.max("top").alias("top")).collect()]
    entries = known.select("home", "qids", "qkeys", "qxs", "floors").mapInPandas(_enter(width, centres, cells), ENTRIES)
    left = entries.join(directories, "dir").mapInPandas(_descend(width), "page long, qids binary, qkeys binary, qxs binary, floors binary")
    away = left.join(pages.select("page", "ids", "xs"), "page").select("page", "ids", "xs", "qids", "qkeys", "qxs", "floors").mapInPandas(_search(width, k), HITS)
    return best_of(home.unionByName(away), k).select("query_id", "rank", "vec_id", "score")
