"""Toxic passages by maximum-scoring segments of token log-odds.

Tokens are runs between ASCII white space, lower-cased and stripped of non-letters at both ends.
Terms are tokens and their first ``STEMS`` letters, so that forms of a word that were never seen
count by their stem. Weights are log-odds with a Dirichlet prior between toxic and other labelled
documents, kept where they are significant; a token weighs what its most significant term does, and
every other token costs ``drift``. A linear-time scan finds all maximal segments of positive score.
Their extreme-value statistics (lambda from the scores' distribution over clean tokens, K from clean
documents' best segments) turn a score into an expected number of chance segments in a text of that
length. The best segment's, whether significant or not, and the sum of the significant ones go through a
logistic calibration to a probability, fitted on documents that no weight was learned from.

The classifier is fitted on at most ``sample`` labelled rows, those with the smallest hash, of which
one in ``CALIBRATE`` calibrates; the vocabulary has at most ``vocabulary`` terms. Scoring covers whole texts.

Cases: null and empty texts have no segment and get the score of one; rows without a label or
document do not train; repeated labels count once (the larger), and so does an id with several
texts (the least one); with no usable labels every score is 0; null ids stay null, held out by the remainder of the empty text; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farpoint.llm.common import checkpoint, flat_words, pick, ranges, remainder, ship, slices, texts_of, tidy

SAMPLE = 20_000
VOCABULARY = 4096
#: Letters of the beginnings of words that are terms.
STEMS = (4, 5, 6)
#: One in so many sampled documents calibrates.
CALIBRATE = 4
#: Pseudo-documents of the prior, spread over tokens by their frequency.
PRIOR = 10.0
#: Least significance and least log-odds of a term; smaller ones tell language and length, not toxicity.
MIN_Z, MIN_ODDS = 3.0, 1.0
DRIFT = 0.05
CLIP = 6.0
#: Expected chance segments up to which a segment counts.
SIGNIFICANT = 0.05
#: Words that are hashed together to tell near copies, and the odd factor of that hash.
WINDOW, MIX = 5, np.uint64(0x9E3779B97F4A7C15)
#: Rows that Parquet's reader holds at a time, unless the session has another value than Spark's default:
#: a column of texts is one array that doubles, of tens of MB for 4,096 rows, and the heap grows around it.
READ_ROWS, READ_CONF, READ_DEFAULT = 512, "spark.sql.parquet.columnarReaderBatchSize", "4096"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Model:
    words: tuple[str, ...] = ()
    weights: tuple[float, ...] = ()
    lam: float = 1.0
    k: float = 1.0
    coefficients: tuple[float, ...] = (-50.0, 0.0, 0.0)


def stems(keys: pa.Array) -> list[pa.Array]:
    """For each of STEMS the beginnings of the words, with a mark; null for shorter words."""
    size = pc.utf8_length(keys)
    cut = lambda n: pc.binary_join_element_wise(pc.utf8_slice_codeunits(keys, 0, n), "*", "")
    return [pc.if_else(pc.greater_equal(size, n), cut(n), pa.scalar(None, pa.string())) for n in STEMS]


def token_keys(words: pa.Array) -> pa.Array:
    """Lower-cased words without non-letters at their ends."""
    return pc.replace_substring_regex(pc.utf8_lower(words), r"^[^\p{L}]+|[^\p{L}]+$", "")


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) with their sums, in linear time.

    Each candidate keeps the running total before (left) and after (right) it; a new positive
    item joins earlier candidates that start lower and end lower.
    """
    segs: list[tuple[int, int, float, float]] = []
    total = 0.0
    for i, s in enumerate(scores):
        if s > 0:
            cur = (i, i + 1, total, total + s)
            while True:
                j = len(segs) - 1
                while j >= 0 and segs[j][2] >= cur[2]:
                    j -= 1
                if j < 0 or segs[j][3] >= cur[3]:
                    segs.append(cur)
                    break
                cur = (segs[j][0], cur[1], segs[j][2], cur[3])
                del segs[j:]
        total += s
    return [(a, b, r - l) for a, b, l, r in segs]


def segments_at(positions: np.ndarray, weights: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """Segments of a text whose weighted tokens stand at ``positions``; all other tokens cost drift."""
    scores, marks = [], []
    last = -1
    for p, w in zip(positions.tolist(), weights.tolist(), strict=True):
        if p - last > 1:
            scores.append(-drift * (p - last - 1))
            marks.append(last + 1)
        scores.append(w)
        marks.append(p)
        last = p
    return [(marks[a], marks[b - 1] + 1, s) for a, b, s in maximal_segments(scores)]


class Scorer:
    def __init__(self, model: Model):
        self.m = model
        self.vocabulary = pa.array(list(model.words), type=pa.string())
        self.weights = np.array([*model.weights, 0.0])

    def segments(self, texts: pa.Array) -> tuple[np.ndarray, dict[int, list[tuple[int, int, float]]]]:
        """(tokens per text, segments of those texts that have any)."""
        index, words, offsets = flat_words(pc.ascii_split_whitespace(texts))
        n = np.diff(offsets)
        if not self.m.words:
            return n, {}
        keys, none = token_keys(words), len(self.m.words)
        # terms stand by significance, so the first one known decides
        at = np.minimum.reduce([pc.fill_null(pc.index_in(t, self.vocabulary, skip_nulls=True), none).to_numpy(zero_copy_only=False) for t in (keys, *stems(keys))])
        w = self.weights[at][index]
        hits = np.flatnonzero(w)
        if not len(hits):
            return n, {}
        rows = np.searchsorted(offsets, hits, side="right") - 1
        out = {}
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(hits)], strict=True):
            if a < b and (w[hits[a:b]] > 0).any():
                row = int(rows[a])
                out[row] = segments_at(hits[a:b] - offsets[row], w[hits[a:b]])
        return n, out

    def log_e(self, score: float, n: int) -> float:
        """log of the chance segments of at least this score expected in n tokens."""
        return math.log(self.m.k * max(n, 1)) - self.m.lam * score

    def features(self, n: int, segs: list[tuple[int, int, float]]) -> tuple[float, float]:
        """(evidence of the best segment, signed; evidence of all significant ones), each log-scaled."""
        # without a segment there is no evidence, however unlikely one by chance would have been
        best = -self.log_e(max(s for _, _, s in segs), n) if segs else min(0.0, -self.log_e(0.0, n))
        strong = [-e for _, _, s in segs if (e := self.log_e(s, n)) <= math.log(SIGNIFICANT)]
        return math.copysign(math.log1p(abs(best)), best), math.log1p(sum(strong))

    def probability(self, x: tuple[float, float]) -> float:
        c = self.m.coefficients
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, c[0] + c[1] * x[0] + c[2] * x[1]))))

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[int, list[tuple[int, int, float]]]]:
        """(scores, token counts, segments)."""
        n, segs = self.segments(texts)
        out = np.array([self.probability(self.features(k, segs.get(i, []))) for i, k in enumerate(n.tolist())], dtype=float)
        return out, n, segs


def prepare(spark: SparkSession) -> None:
    """Ships the package and bounds what Parquet's reader holds."""
    ship(spark)
    if spark.conf.get(READ_CONF) == READ_DEFAULT:
        spark.conf.set(READ_CONF, READ_ROWS)


def shingle_keys(texts: pa.Array) -> np.ndarray:
    """The smallest hash of five words of each text; with fewer words, the hash of the text."""
    digest = lambda t: int.from_bytes(blake2b(t.encode(), digest_size=8).digest(), "little")
    index, words, offsets = flat_words(pc.ascii_split_whitespace(pc.utf8_lower(texts)))
    n = np.diff(offsets)
    out = np.zeros(len(n), dtype=np.uint64)
    for i in np.flatnonzero(n < WINDOW).tolist():
        out[i] = digest(texts[i].as_py())
    long = np.flatnonzero(n >= WINDOW)
    if len(long):
        word = np.array([digest(w) for w in words.to_pylist()], dtype=np.uint64)[index]
        windows = np.zeros(len(word) - WINDOW + 1, dtype=np.uint64)
        for k in range(WINDOW):
            windows = windows * MIX + word[k : len(word) - WINDOW + 1 + k]
        windows = (windows ^ (windows >> np.uint64(29))) * MIX
        sizes = n[long] - WINDOW + 1
        out[long] = np.minimum.reduceat(windows[ranges(offsets[long], sizes)], np.cumsum(sizes) - sizes)
    return out.view(np.int64)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int, hold_out: int) -> DataFrame:
    """(text, y) of the sample; labels by ids only, so a text is read where its id is among them."""
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("y")).filter("doc_id is not null and y is not null")
    known = known.filter(remainder("doc_id", hold_out) != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen), "doc_id").filter("text is not null")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys = pa.array(shingle_keys(texts_of(part)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "text", "y")), keys], names=["doc_id", "text", "y", "key"])

    # near copies would make their own words look significant: one text stays of those that share
    # the smallest hash of five words. In SQL the lists of words would be garbage of many times the text
    keyed = rows.mapInArrow(tidy(run), f"doc_id {kind}, text string, y int, key long")
    best = keyed.groupBy("key", "y").agg(F.min(F.struct("doc_id", "text")).alias("best"))
    once = best.groupBy("best.doc_id").agg(F.min("best.text").alias("text"), F.max("y").alias("y"))  # at most ``sample`` rows
    return once.select("text", "y", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(CALIBRATE)) == 0).alias("calibrates"))


def word_table(rows: DataFrame) -> DataFrame:
    """(word, t, c, ct): toxic documents, other documents, and tokens of other documents per term; "" holds totals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                y = part.column("y").to_numpy(zero_copy_only=False)
                index, words, offsets = flat_words(pc.ascii_split_whitespace(texts_of(part)))
                doc = np.repeat(np.arange(len(y)), np.diff(offsets))
                table: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
                table[""] = [int((y == 1).sum()), int((y == 0).sum()), int((y[doc] == 0).sum())]
                keys = token_keys(words)
                for terms in (keys, *stems(keys)):
                    # documents by distinct term: a word may come with several signs around it
                    coded = terms.dictionary_encode()
                    code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)[index]
                    own, d = code[code >= 0], doc[code >= 0]
                    width = max(len(coded.dictionary), 1)
                    pairs = np.unique(d * width + own)
                    of, at = pairs % width, pairs // width
                    cols = [np.bincount(of[y[at] == v], minlength=width) for v in (1, 0)] + [np.bincount(own[y[d] == 0], minlength=width)]
                    for i, w in enumerate(coded.dictionary.to_pylist()):
                        if w:
                            table[w] = [int(c[i]) for c in cols]
                yield pa.RecordBatch.from_arrays([pa.array(list(table)), *[pa.array([v[i] for v in table.values()], type=pa.int64()) for i in range(3)]], names=["word", "t", "c", "ct"])

    parts = rows.mapInArrow(tidy(run), "word string, t long, c long, ct long")
    return parts.groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum("ct").alias("ct"))


def root_of_scores(weights: np.ndarray, shares: np.ndarray, drift: float = DRIFT) -> float:
    """lambda > 0 with sum of share * exp(lambda * score) = 1; 1 where there is none."""
    rest = max(0.0, 1 - float(shares.sum()))
    f = lambda x: float((shares * np.exp(x * weights)).sum()) + rest * math.exp(-x * drift) - 1
    if not len(weights) or (shares * weights).sum() - rest * drift >= 0:
        return 1.0
    lo, hi = 1e-6, 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a small ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, vocabulary: int = VOCABULARY, hold_out: int = 5) -> Model:
    """Learns from labelled rows whose crc32(id) mod ``hold_out`` is not 0."""
    prepare(docs.sparkSession)
    rows = checkpoint(training_rows(docs, labels, id_col, text_col, sample, hold_out))
    counts = word_table(rows.filter("not calibrates")).withColumn("n", F.col("t") + F.col("c")).filter("n >= 3")
    # significance in SQL, so that only the vocabulary comes to the driver
    totals = counts.filter("word = ''").first()
    if totals is None or not totals["t"] or not totals["c"]:
        return Model()
    n1, n0, tokens = totals["t"], totals["c"], max(1, totals["ct"])
    prior = F.col("n") * (PRIOR / (n1 + n0))
    odds = lambda hit, all_: F.log((hit + prior) / (F.lit(float(all_)) - hit + PRIOR))
    delta = odds(F.col("t"), n1) - odds(F.col("c"), n0)
    z = delta / F.sqrt(1 / (F.col("t") + prior) + 1 / (F.col("c") + prior))
    kept = counts.filter("word <> ''").withColumns({"d": delta, "z": z}).filter((F.abs("z") >= MIN_Z) & (F.abs("d") >= MIN_ODDS))
    table = kept.orderBy(F.desc(F.abs("z")), "word").limit(vocabulary).select("word", "d", "ct").collect()
    words, weights = tuple(r["word"] for r in table), np.clip(np.array([r["d"] for r in table], dtype=float), -CLIP, CLIP)
    shares = (np.array([r["ct"] for r in table], dtype=float) + 0.5) / tokens
    lam = root_of_scores(weights, shares)
    first = Model(words, tuple(weights.tolist()), lam)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(first)
        for batch in batches:
            for part in slices(batch):
                n, segs = scorer.segments(texts_of(part))
                lists = [[s for _, _, s in segs.get(i, [])] for i in range(len(n))]
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(n, type=pa.int64()), pa.array(lists, type=pa.list_(pa.float64()))], names=["y", "n", "s"])

    # one short row per sampled document, at most ``sample``
    seen = rows.filter("calibrates").mapInArrow(tidy(best), "y int, n long, s array<double>").collect()
    clean = [lam * max(r["s"], default=0.0) - math.log(max(r["n"], 1)) for r in seen if r["y"] == 0]
    k = math.exp(min(50.0, float(np.mean(clean)) - 0.5772156649015329)) if clean else 1.0
    if len({r["y"] for r in seen}) < 2:
        return Model()
    scorer = Scorer(Model(words, tuple(weights.tolist()), lam, k))
    x = np.array([scorer.features(r["n"], [(0, 0, s) for s in r["s"]]) for r in seen])
    c = logistic(x, np.array([float(r["y"] == 1) for r in seen]))
    return Model(words, tuple(weights.tolist()), lam, k, tuple(float(v) for v in c))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", hold_out: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) for every row; passages in code points, end exclusive."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("log_e", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part)
                p, n, segs = scorer.score(texts)
                spans: list[list[dict]] = [[] for _ in range(len(p))]
                for i, found in segs.items():
                    strong = [(a, b, s, e) for a, b, s in found if (e := scorer.log_e(s, int(n[i]))) <= math.log(SIGNIFICANT)]
                    if strong:
                        text = texts[i].as_py()
                        at = [m.span() for m in WORD.finditer(text)]
                        lead = 1 if WORD.match(text) is None else 0  # splitting yields an empty token before leading white space
                        spans[i] = [{"start": at[a - lead][0], "end": at[b - 1 - lead][1], "score": s, "log_e": e} for a, b, s, e in strong]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(spans, type=pa.list_(span))], names=["doc_id", "held_out", "score", "predicted", "passages"])

    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("held_out", remainder("doc_id", hold_out) == 0)
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, score double, predicted int, passages array<struct<start:bigint,end:bigint,score:double,log_e:double>>")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score under the threshold, unchanged."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(scorer.score(texts_of(part, text_col))[0] < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
