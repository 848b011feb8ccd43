"""N-gram Jaccard join by signature trees: components of documents that share enough shingles.

1. Every text becomes its set of distinct hashed shingles; equal sets become one representative,
   so copies are never paired.
2. A set can only have a partner if enough of its least tokens, by hash, are also among those of
   another set: the first common tokens of two similar sets stand in the heads of both. Heads are dealt by
   hash into ranges, as packed arrays, to count such tokens; sets with too few of them are done.
3. Prefix filter among the rest: if two sets of n and m tokens are similar enough, the
   n - ceil(t n) + 1 first tokens of either, in any order common to all, share one. The order is by
   document frequency, rarest first. Representatives under a token are joined to the least of them,
   and the components of these edges, families, hold every possible link.
4. Families are dealt into blocks of bounded size. In each block a signature tree is built: leaves
   of similar sets, nodes with OR-combined token bitmaps and size ranges. Dual traversal drops pairs of
   nodes whose greatest possible overlap is too small; pairs already connected are skipped; the
   rest are counted exactly.
5. Of a family of several blocks, the most typical set of each component so far goes on to the next round of
   blocks, until rounds join little. Then all sets still apart whose sizes allow a link are paired, block by
   block, in the same way. Links between different sets are never lost: bounds are exact and nothing is capped.

Cases: null or blank texts have no shingles and link with nothing; fewer words than a shingle
make one; repeated rows share their component; rows that repeat a doc_id with another text may
share its component; rows with a null doc_id link with nothing and have a null component; an
empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farpoint.llm.common import checkpoint, flat_words, pick, ship, slices, sweep, texts_of, tidy
from farpoint.llm.graph import components

#: Tokens of a range, about.
RANGE_TOKENS = 2_000_000
#: Documents, about, whose counts are summed at a time.
BUCKET_DOCS = 200_000
#: Tokens, about, that a worker sorts at a time before they are dealt.
RUN_TOKENS = 1_000_000
#: Sets in a block.
BLOCK = 512
#: Rows up to which a table of ids is broadcast; beyond, it is joined by shuffle.
SMALL = 500_000
LEAF, FAN = 16, 8
#: Least tokens of a set that must be shared, per cent, before it is looked at closer.
SHARED = 30


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    index, words, offsets = flat_words(pc.ascii_split_whitespace(pc.ascii_lower(texts)))
    names = words.to_pylist()
    codes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), dtype=np.uint64, count=len(names))
    real = np.array([w != "" for w in names], dtype=bool)[index] if len(index) else np.zeros(0, dtype=bool)
    run = np.concatenate([[0], np.cumsum(real)])
    offsets = run[offsets]
    h = codes[index[real]] if len(index) else np.zeros(0, dtype=np.uint64)
    grams = np.zeros(max(len(h) - width + 1, 0), dtype=np.uint64)
    for j in range(width):
        grams = mix64(grams + np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(grams)])
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(grams[a : b - width + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            x = np.array([b - a], dtype=np.uint64)
            for w in h[a:b].reshape(-1, 1):
                x = mix64(x + w)
            out.append(x)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def needed(n: int, m: int, percent: int) -> int:
    """Least overlap with 100 * overlap >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def part(n: int, percent: int) -> int:
    """percent of n, rounded up."""
    return -(-percent * n // 100)


def head(tokens: np.ndarray, percent: int) -> np.ndarray:
    """The least tokens of a sorted set: those of two similar sets share SHARED per cent of the smaller set.

    Two sets of n and m tokens with a common ones, a >= percent of either, share their k first common tokens
    within their n - a + k and m - a + k least tokens, for any k up to a.
    """
    n = len(tokens)
    return tokens[: n - part(n, percent) + part(n, min(SHARED, percent))]


class SignatureTree:
    """Paged tree over sets: per node an OR bitmap, size range and the most tokens lost to shared bits."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.sets, self.bits = sets, bits
        n = len(sets)
        self.size = np.array([len(s) for s in sets])
        order = sorted(range(n), key=lambda i: (int(sets[i][0]), int(sets[i][min(1, len(sets[i]) - 1)]), i))
        maps = np.zeros((n, bits // 64), dtype=np.uint64)
        for i, s in enumerate(sets):
            np.bitwise_or.at(maps[i], (s % np.uint64(bits) >> np.uint64(6)).astype(np.int64), np.uint64(1) << (s & np.uint64(63)))
        self.maps = maps
        self.lost = self.size - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        level = [self._node([order[i : i + LEAF]], None) for i in range(0, n, LEAF)]
        while len(level) > 1:
            level = [self._node([x[4] for x in level[i : i + FAN]], level[i : i + FAN]) for i in range(0, len(level), FAN)]
        self.root = level[0] if level else None

    def _node(self, members: list[list[int]], children):
        m = [i for g in members for i in g]
        return (np.bitwise_or.reduce(self.maps[m], axis=0), int(self.size[m].min()), int(self.size[m].max()), int(self.lost[m].max()), m, children)


def may_link(p, q, percent: int) -> bool:
    """Whether any set under p can be similar enough to any under q, by sizes and bitmaps."""
    if 100 * p[2] < percent * q[1] or 100 * q[2] < percent * p[1]:
        return False
    common = int(np.bitwise_count(p[0] & q[0]).sum())
    most = min(common + min(p[3], q[3]), p[2], q[2])
    return most >= needed(p[1], q[1], percent)


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common tokens of two sorted sets."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def traverse(t: SignatureTree, u: SignatureTree, shift: int, union: Union, percent: int) -> list[tuple[int, int]]:
    """Links between members of two trees (or of one with itself) that connect what was not connected.

    Members of ``u`` are numbered from ``shift`` in ``union``.
    """
    out: list[tuple[int, int]] = []
    if t.root is None or u.root is None:
        return out
    stack = [(t.root, u.root)]
    while stack:
        p, q = stack.pop()
        if not may_link(p, q, percent):
            continue
        roots = {union.find(i) for i in p[4]}
        if len(roots) == 1 and roots == {union.find(shift + j) for j in q[4]}:
            continue
        if p[5] is None and q[5] is None:
            for i in p[4]:
                for j in q[4]:
                    if p is q and j <= i or union.find(i) == union.find(shift + j):
                        continue
                    n, m = int(t.size[i]), int(u.size[j])
                    need = needed(n, m, percent)
                    if min(n, m) < need or int(np.bitwise_count(t.maps[i] & u.maps[j]).sum()) + min(t.lost[i], u.lost[j]) < need:
                        continue
                    if overlap(t.sets[i], u.sets[j]) >= need:
                        union.join(i, shift + j)
                        out.append((i, j))
        elif t is u and p is q:
            kids = p[5]
            stack += [(kids[x], kids[y]) for x in range(len(kids)) for y in range(x, len(kids))]
        elif p[5] is not None and (q[5] is None or len(p[4]) >= len(q[4])):
            stack += [(k, q) for k in p[5]]
        else:
            stack += [(p, k) for k in q[5]]
    return out


def width_for(sets: list[np.ndarray]) -> int:
    """Bits of the bitmaps: twice the largest set, a power of two from 256 to 16384."""
    return 1 << min(14, max(8, (2 * max((len(s) for s in sets), default=1)).bit_length()))


def _decode(column) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in column]


def _links_within(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, g in pdf.groupby("fam", sort=False):
            if len(g) < 2:
                continue
            ids, sets = g["rep"].tolist(), _decode(g["tokens"])
            t = SignatureTree(sets, width_for(sets))
            out += [(ids[i], ids[j]) for i, j in traverse(t, t, 0, Union(len(ids)), percent)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return run


def _links_between(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(left):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        one = not len(right)  # a block of many small components, with itself
        ids, sets, comps = left["rep"].tolist(), _decode(left["tokens"]), left["comp"].tolist()
        others, osets = ([], []) if one else (right["rep"].tolist(), _decode(right["tokens"]))
        bits = width_for(sets + osets)
        t = SignatureTree(sets, bits)
        u = t if one else SignatureTree(osets, bits)
        shift = 0 if one else len(ids)
        union, first = Union(len(ids) + len(others)), {}
        for i, c in enumerate(comps + ([] if one else right["comp"].tolist())):
            union.join(first.setdefault(c, i), i)
        names = ids if one else others
        out = [(ids[i], names[j]) for i, j in traverse(t, u, shift, union, percent)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return run


def repeated_counts(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, c): how many tokens of a document's head occur in another one's head too; none missing means 0.

    Tokens repeated within a run of documents are counted there and sent once, so a very common
    token costs its range one entry a run. A run ends once it holds ``RUN_TOKENS``, however wide the batches.
    Ranges compare 32 more bits of the hash; tokens that agree in those only add to c, which may be too
    large but never too small. Counts come from a range as one row for each bucket of documents.
    """
    found = docs.agg(F.sum(F.length("text")), F.count(F.lit(1))).first()
    tokens = (found[0] or 0) / 6 * (100 - percent + SHARED) / 100
    bits = max(3, math.ceil(math.log2(tokens / RANGE_TOKENS + 1)))
    buckets = max(1, math.ceil(found[1] / BUCKET_DOCS))
    none = np.iinfo(np.int64).min

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
        ids, sets, held = [], [], 0
        for batch in batches:
            for piece in slices(batch):
                ids += piece.column("doc_id").to_pylist()
                heads = [head(s, percent) for s in shingle_sets(texts_of(piece), width)]
                sets += heads
                held += sum(map(len, heads))
                if held >= RUN_TOKENS:
                    yield ids, sets
                    ids, sets, held = [], [], 0
        if held:
            yield ids, sets

    def bucketed(ids: np.ndarray, counts: np.ndarray) -> list[tuple[int, bytes, bytes]]:
        if not len(ids):
            return []
        of = (mix64(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        own, starts = np.unique(of[order], return_index=True)
        return [(b, i.tobytes(), c.tobytes()) for b, i, c in zip(own.tolist(), np.split(ids[order], starts[1:]), np.split(counts[order], starts[1:]), strict=True)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in runs(batches):
            doc = np.repeat(np.array(ids, dtype=np.int64), [len(s) for s in sets])
            token = np.concatenate(sets)
            sets.clear()
            token = token << np.uint64(64 - bits) | token >> np.uint64(bits)  # low bits tell the range
            order = np.argsort(token, kind="stable")
            token, doc = token[order], doc[order]
            del order
            same = token[1:] == token[:-1]
            again = np.append(False, same) | np.append(same, False)
            first = np.append(True, ~same)
            own, n = np.unique(doc[again], return_counts=True)
            rows = [(-1 - b, i, c) for b, i, c in bucketed(own, n.astype(np.int64))]
            # a token of one document goes with it, one of several goes once, without a document
            token, known, doc = token[first], again[first], doc[first]
            where = (token >> np.uint64(64 - bits)).astype(np.int64)
            key = (token >> np.uint64(32 - bits)).astype(np.uint32)
            own, starts = np.unique(where, return_index=True)
            for r, k, known_, d in zip(own.tolist(), np.split(key, starts[1:]), np.split(known, starts[1:]), np.split(doc, starts[1:]), strict=True):
                rows.append((r, np.concatenate([k[~known_], k[known_]]).tobytes(), d[~known_].tobytes()))
            kinds = (pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["range", "x", "y"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        r = int(pdf["range"].iloc[0])
        if r < 0:  # counts already, of one bucket
            rows = [(-1 - r, x, y) for x, y in zip(pdf["x"], pdf["y"], strict=True)]
            return pd.DataFrame(rows, columns=["bucket", "ids", "counts"])
        keys = [np.frombuffer(x, dtype=np.uint32) for x in pdf["x"]]
        docs_ = [np.frombuffer(y, dtype=np.int64) for y in pdf["y"]]
        key = np.concatenate(keys)
        doc = np.concatenate([np.append(d, np.full(len(k) - len(d), none)) for k, d in zip(keys, docs_, strict=True)])
        order = np.argsort(key, kind="stable")
        key, doc = key[order], doc[order]
        same = key[1:] == key[:-1]
        again = (np.append(False, same) | np.append(same, False)) & (doc != none)
        own, n = np.unique(doc[again], return_counts=True)
        return pd.DataFrame(bucketed(own, n.astype(np.int64)), columns=["bucket", "ids", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in pdf["ids"]])
        counts = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in pdf["counts"]])
        own, at = np.unique(ids, return_inverse=True)
        return pd.DataFrame({"doc_id": own, "c": np.bincount(at, weights=counts, minlength=len(own)).astype(np.int64)})

    dealt = docs.filter("doc_id is not null").mapInArrow(tidy(deal), "range long, x binary, y binary")
    packed = dealt.groupBy("range").applyInPandas(count, "bucket long, ids binary, counts binary")
    return packed.groupBy("bucket").applyInPandas(add, "doc_id long, c long")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; similarity of at least ``percent`` / 100."""
    spark = df.sparkSession
    ship(spark)
    docs = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = shingle_sets(texts_of(part), width)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in found], type=pa.int64()), pa.array(digests, type=pa.binary())], names=["doc_id", "n", "digest"])

    rows = checkpoint(docs.mapInArrow(tidy(sets), "doc_id long, n long, digest binary"))
    linkable = rows.filter("doc_id is not null and digest is not null")
    # copies of a set are combined before the shuffle
    reps = checkpoint(linkable.groupBy("digest", "n").agg(F.min("doc_id").alias("rep")))
    counts = repeated_counts(docs, width, percent)
    least = F.ceil(F.col("n") * percent / 100)  # tokens of the smallest partner, and what it must share
    enough = F.ceil(least * min(SHARED, percent) / 100)
    hopeful = checkpoint(reps.join(counts, F.col("rep") == F.col("doc_id")).filter(F.col("c") >= enough).groupBy("rep").agg(F.max(F.col("c") / F.col("n")).alias("share")))
    sets_ = checkpoint(with_tokens(docs, hopeful, hopeful.count(), width))
    sweep(spark)
    families = checkpoint(components(chains(sets_, percent)).select(F.col("node").alias("rep"), F.col("root").alias("fam")))
    sizes = families.groupBy("fam").agg(F.count(F.lit(1)).alias("members"))
    active = families.count()
    groups = max(1, math.ceil(active / block))
    blocks = F.ceil(F.col("members") / block)
    where = F.when(blocks > 1, F.concat_ws(":", F.lit("f"), "fam", F.pmod(F.xxhash64("rep"), blocks))).otherwise(F.concat_ws(":", F.lit("s"), F.pmod(F.xxhash64("fam"), F.lit(groups))))
    placed = checkpoint(families.join(sizes, "fam").select("rep", "fam", "members", where.alias("task")))
    within = lambda tasks: checkpoint(_beside(sets_, tasks, active).groupBy("task").applyInPandas(_links_within(percent), "a long, b long"))
    local = within(placed.select("rep", "fam", "task"))
    large = placed.filter(F.col("members") > block).select("rep", "fam").join(sets_.groupBy("rep").agg(F.max("share").alias("share")), "rep")
    found = components(local if large.isEmpty() else links_across(sets_, checkpoint(large), local, within, active, block, percent))
    names = reps.select("digest", "rep").join(found, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("root", "rep").alias("component"))
    members = rows.join(names, "digest", "left")
    return members.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def chains(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): representatives and the least one with a token in common in their prefixes."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(t, dtype=np.int64) for t in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(lists, type=pa.list_(pa.int64()))], names=["rep", "tokens"])

    tokens = sets.mapInArrow(tidy(spread), "rep long, tokens array<long>").select("rep", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    held = tokens.join(shared, "token")
    per = Window.partitionBy("rep")
    rank = F.row_number().over(per.orderBy("df", "token"))
    # tokens of one set alone come first in the order and lead nowhere
    alone = F.col("n") - F.count(F.lit(1)).over(per)
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    kept = held.withColumn("rank", rank).withColumn("most", prefix - alone).filter(F.col("rank") <= F.col("most"))
    # the least representative of a token, found by partial aggregates; tokens of one representative lead nowhere
    first = kept.groupBy("token").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).filter("b <> last").select("token", "b")
    return kept.select("rep", "token").join(first, "token").filter("b <> rep").select(F.col("rep").alias("a"), "b").distinct()


def with_tokens(docs: DataFrame, chosen: DataFrame, rows: int, width: int) -> DataFrame:
    """``chosen`` (rep, ...) with the sorted shingles of each rep's text, as bytes."""
    names = [c for c in chosen.columns if c != "rep"]
    kinds = dict(chosen.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = shingle_sets(texts_of(part), width)
                out = pa.RecordBatch.from_arrays([*[part.column(c) for c in ("rep", *names)], pa.array([s.tobytes() for s in found], type=pa.binary())], names=["rep", *names, "tokens"])
                yield out.filter(pa.array([len(s) > 0 for s in found]))

    picked = docs.withColumnRenamed("doc_id", "rep").join(F.broadcast(chosen) if rows <= SMALL else chosen, "rep").select("rep", *names, "text")
    return picked.mapInArrow(tidy(run), ", ".join(f"{c} {kinds[c]}" for c in ("rep", *names)) + ", tokens binary")


def _beside(sets: DataFrame, tasks: DataFrame, rows: int) -> DataFrame:
    """tasks (rep, ...), of at most ``rows`` rows, with the tokens of each rep."""
    return sets.join(F.broadcast(tasks) if rows <= SMALL else tasks, "rep")


def links_across(sets: DataFrame, members: DataFrame, local: DataFrame, within, active: int, block: int, percent: int) -> DataFrame:
    """``local`` links and those between blocks of families larger than a block. members: rep, fam, share of tokens found elsewhere."""
    links, before, turn = local, math.inf, 0
    while True:
        comp = components(links).select(F.col("node").alias("rep"), F.col("root").alias("comp"))
        known = checkpoint(members.join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")))
        # the member with the most tokens found elsewhere stands for its component: others were likely made from it
        leaders = known.groupBy("fam", "comp").agg(F.max_by("rep", F.struct("share", -F.col("rep"))).alias("rep")).select("rep", "fam")
        per = leaders.groupBy("fam").agg(F.count(F.lit(1)).alias("comps")).filter("comps > 1")
        leaders = checkpoint(leaders.join(per, "fam"))
        left = leaders.count()
        if not left:
            return links
        if left > 0.9 * before:
            break
        before, turn = left, turn + 1
        blocks = F.ceil(F.col("comps") / block)
        task = F.concat_ws(":", "fam", F.pmod(F.xxhash64("rep", F.lit(turn)), blocks))
        links = checkpoint(links.unionByName(within(leaders.select("rep", "fam", task.alias("task")))))
    known = known.select("rep", "fam", "comp").join(per, "fam")
    size = (F.length("tokens") / 8).cast("long")
    # two sets in classes that are not next to each other differ too much in size
    step = math.log(100 / percent) + 1e-9 if percent < 100 else 1e-9
    sized = _beside(sets.select("rep", F.floor(F.log(size.cast("double")) / step).alias("class")), known, active)
    counted = sized.groupBy("fam", "comp").agg(F.count(F.lit(1)).alias("n"))
    sized = sized.join(counted, ["fam", "comp"]).withColumn("whole", F.when(F.col("n") >= block, F.col("comp")))
    spread = sized.groupBy("fam", "class", "whole").agg(F.ceil(F.count(F.lit(1)) / block).alias("chunks"))
    same = (F.col("s.fam") == F.col("p.fam")) & (F.col("s.class") == F.col("p.class")) & F.col("s.whole").eqNullSafe(F.col("p.whole"))
    number = F.pmod(F.xxhash64("s.rep"), F.col("p.chunks"))
    chunk = F.concat_ws(":", F.col("s.class"), F.coalesce(F.col("s.whole").cast("string"), F.lit("m")), number)
    dealt = checkpoint(sized.alias("s").join(spread.alias("p"), same).select("s.rep", "s.fam", "s.comp", "s.class", "s.whole", chunk.alias("chunk")))
    chunks = dealt.select("fam", "chunk", "class", "whole").distinct()
    near = chunks.withColumn("class", F.explode(F.array(*[F.col("class") + i for i in (-1, 0, 1)])))
    other = near.select("fam", "class", F.col("chunk").alias("chunk2"), F.col("whole").alias("whole2"))
    apart = F.coalesce(F.col("whole") != F.col("whole2"), F.lit(True))
    pairs = chunks.join(other, ["fam", "class"]).filter((F.col("chunk") < F.col("chunk2")) & apart | (F.col("chunk") == F.col("chunk2")) & F.col("whole").isNull())
    pairs = checkpoint(pairs.select("fam", "chunk", "chunk2"))
    key = F.concat_ws("|", "fam", "chunk", "chunk2")
    left = dealt.join(pairs, ["fam", "chunk"]).select("rep", "comp", key.alias("task"), F.lit(0).alias("side"))
    right = dealt.join(pairs.filter("chunk <> chunk2").withColumnsRenamed({"chunk": "chunk1"}).withColumn("chunk", F.col("chunk2")), ["fam", "chunk"]).select(
        "rep", "comp", F.concat_ws("|", "fam", "chunk1", "chunk2").alias("task"), F.lit(1).alias("side"))
    work = checkpoint(left.unionByName(right))
    between = _beside(sets, work, work.count()).groupBy("task").applyInPandas(_links_between(percent), "a long, b long")
    return links.unionByName(checkpoint(between))
