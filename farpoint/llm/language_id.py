"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a labelled reference text. A text is parsed greedily
into the longest matches that the automaton allows; phrases, normalised by text length and
reference size, estimate the cross entropy, and the language with the least wins (ties: by name).

Texts are lower-cased; all but letters become one space. Parsing runs in lock-step over lanes of
``LANE`` characters, one array step per character. A lane is first parsed as if a phrase began with
it, and then anew from the phrase that reaches into it, until the two parses begin a phrase at the same
place; so phrases are those of one parse of the whole text. Every letter of the references has a
symbol of its own. Every language is learned, from the documents with the smallest hash, at most
``DOCS`` of them, until ``REFERENCE`` characters are reached; of a text of more than ``PIECE``
characters a piece of that length at a place by its hash is taken.

Cases: null texts and texts without a letter are ``und`` with score 0, as is everything when
nothing was learned; null languages do not train; repeated rows are predicted each; null ids stay
null, held out by the remainder of the empty text; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farpoint.llm.common import keep, pick, remainder, row_sums, ship, slices, tidy

DOCS = 200
PIECE = 4000
#: Characters of a language's reference.
REFERENCE = 20_000
LANE = 256
#: Entries that the tables of all languages together may have; beyond that, transitions are kept sorted.
DENSE = 16 << 20
#: Rows of ids that are broadcast.
SMALL = 100_000


class Alphabet:
    """Symbols of code points: 0 for the space, 1 for letters that no reference has, then the others by frequency."""

    def __init__(self, references: dict[str, str]):
        counts: dict[str, int] = {}
        for text in references.values():
            for ch in text.lower():
                if ch.isalpha():
                    counts[ch] = counts.get(ch, 0) + 1
        self.table = np.zeros(0x110000, dtype=np.int32)
        for i in range(0x110000):
            if chr(i).isalpha():
                self.table[i] = 1
        for s, ch in enumerate(sorted(counts, key=lambda c: (-counts[c], c))):
            self.table[ord(ch)] = s + 2
        self.size = len(counts) + 2

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all texts with runs of spaces as one, offsets per text)."""
        low = [(t or "").lower() for t in texts]
        sizes = np.fromiter(map(len, low), dtype=np.int64, count=len(low))
        codes = self.table[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        starts = np.cumsum(sizes) - sizes
        keep = codes > 0
        keep[1:] |= codes[:-1] > 0
        keep[starts[sizes > 0]] = True
        run = np.concatenate([[0], np.cumsum(keep)])
        return codes[keep], np.append(run[starts], run[-1])


def automaton(symbols: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(states, from, symbol, to) of the transitions of the suffix automaton, by state and symbol; 0 is the initial state."""
    go: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols.tolist():
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    flat = np.array([(s, c, edges[c]) for s, edges in enumerate(go) for c in sorted(edges)], dtype=np.int32).reshape(-1, 3)
    return len(go), flat[:, 0].copy(), flat[:, 1].copy(), flat[:, 2].copy()


class Moves:
    """Steps of one automaton over the symbols of its own reference; column 0 is for all others. A step to 0 means none."""

    def __init__(self, parts: tuple[int, np.ndarray, np.ndarray, np.ndarray], size: int):
        self.states, source, symbol, self.to = parts
        own = np.unique(symbol)
        self.width = len(own) + 1
        self.column = np.zeros(size, dtype=np.int32)
        self.column[own] = np.arange(1, self.width)
        self.keys = source.astype(np.int64) * self.width + self.column[symbol]  # rising, as symbols and columns rise together
        self.table = None

    def fill(self) -> None:
        self.table = np.zeros(self.states * self.width, dtype=np.int32)
        self.table[self.keys] = self.to

    def step(self, s: np.ndarray, c: np.ndarray) -> np.ndarray:
        key = s.astype(np.int64) * self.width + c
        if self.table is not None:
            return self.table[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], 0)


def begin(moves: Moves, own: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray, order: np.ndarray, active: np.ndarray) -> np.ndarray:
    """1 where a phrase begins. A phrase ends before a symbol that cannot follow; one that the reference lacks is a phrase.

    ``before`` is the lane that a lane goes on from, or -1.
    """
    root = moves.step(np.zeros(moves.width, dtype=np.int32), np.arange(moves.width))
    begins = np.zeros(len(own), dtype=np.int8)

    def step(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = own[at]
        to = moves.step(s, c)
        miss = to == 0
        return np.where(miss, root[c], to), miss | (s == 0)

    state = np.zeros(len(start), dtype=np.int32)
    for t, a in enumerate(active.tolist()):
        if not a:
            break
        state[:a], begins[start[order[:a]] + t] = step(state[:a], start[order[:a]] + t)
    leaves = np.zeros(len(start), dtype=np.int32)
    leaves[order] = state
    entered = np.zeros(len(start), dtype=np.int32)
    while True:
        lanes = np.flatnonzero((before >= 0) & (leaves[before] != entered))
        if not len(lanes):
            return begins
        s = entered[lanes] = leaves[before[lanes]]
        t = 0
        while len(lanes):
            at = start[lanes] + t
            s, new = step(s, at)
            on = ~(new & (begins[at] > 0))  # where both parses begin a phrase, the rest of the lane is the same
            begins[at[on]] = new[on]
            lanes, s, t = lanes[on], s[on], t + 1
            over = size[lanes] <= t
            leaves[lanes[over]] = s[over]
            lanes, s = lanes[~over], s[~over]


class Parser:
    def __init__(self, references: dict[str, str]):
        self.languages = sorted(references)
        self.alphabet = Alphabet(references) if references else None
        self.moves, self.costs = [], []
        for lang in self.languages:
            symbols, _ = self.alphabet.encode([references[lang]])
            self.moves.append(Moves(automaton(symbols), self.alphabet.size))
            self.costs.append(math.log(len(symbols) + 1))
        if sum(m.states * m.width for m in self.moves) <= DENSE:
            for m in self.moves:
                m.fill()

    def phrases(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases per text and language."""
        n = np.diff(offsets)
        per = (n + LANE - 1) // LANE
        doc = np.repeat(np.arange(len(n)), per)
        first = np.concatenate([[0], np.cumsum(per)])[:-1]
        start = offsets[:-1][doc] + (np.arange(len(doc)) - first[doc]) * LANE
        size = np.minimum(LANE, offsets[1:][doc] - start)
        before = np.where(np.arange(len(doc)) > first[doc], np.arange(len(doc)) - 1, -1)
        order = np.argsort(-size, kind="stable")
        active = np.searchsorted(-size[order], -np.arange(LANE), side="left")  # lanes longer than t
        out = np.zeros((len(n), len(self.moves)))
        for j, moves in enumerate(self.moves):
            begins = begin(moves, moves.column[symbols], start, size, before, order, active)
            out[:, j] = row_sums(begins, offsets)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        symbols, offsets = self.alphabet.encode(texts)
        letters = np.concatenate([[0], np.cumsum(symbols > 0)])
        has = letters[offsets[1:]] > letters[offsets[:-1]]
        cost = self.phrases(symbols, offsets) * np.array(self.costs)
        best = cost.argmin(axis=1)
        gap = cost - cost[np.arange(len(cost)), best][:, None]
        score = 1 / np.exp(-np.minimum(gap, 50) * 0.5).sum(axis=1)
        return [self.languages[b] if h else "und" for b, h in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, score, 0.0).tolist()


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", hold_out: tuple[int, int] = (4, 2), docs_per_language: int = DOCS) -> dict[str, str]:
    """Reference text by language, from labelled rows whose crc32(id) remainder is not held out."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", hold_out[0]) != hold_out[1]))
    narrow = rows.select("doc_id", "lang")
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = narrow.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= docs_per_language).select("doc_id", "lang").distinct()
    # texts of a language up to the length of its reference, before they reach the driver
    if narrow.select("lang").distinct().count() * docs_per_language <= SMALL:
        chosen = F.broadcast(chosen)
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.length("text") - PIECE + 1).cast("int") + 1
    piece = F.when(F.length("text") > PIECE, F.substr("text", place, F.lit(PIECE))).otherwise(F.col("text"))
    got = rows.select("lang", "doc_id", piece.alias("text")).join(chosen, ["doc_id", "lang"])
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    got = got.withColumn("n", F.row_number().over(order)).withColumn("before", F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    out: dict[str, str] = {}
    for r in got.filter((F.col("n") <= docs_per_language) & (F.coalesce("before", F.lit(0)) < REFERENCE)).orderBy("lang", "n").collect():
        out[r["lang"]] = out.get(r["lang"], "") + " " + r["text"]
    return {lang: text for lang, text in out.items() if any(map(str.isalpha, text))}


_PARSERS: dict[int, Parser] = keep(__name__)


def parser(references: dict[str, str]) -> Parser:
    key = hash(tuple(sorted(references.items())))
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = Parser(references)
    return _PARSERS[key]


def predict(docs: DataFrame, references: dict[str, str], id_col: str = "doc_id", text_col: str = "text", hold_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(references)
        for batch in batches:
            for part in slices(batch):
                lang, score = p.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, type=pa.string()), pa.array(score, type=pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("held_out", remainder("doc_id", hold_out[0]) == hold_out[1])
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
