"""Token counts by heap-and-linked-list byte-pair merging.

A piece starts as its bytes. A heap holds the adjacent pairs that can merge, by (rank,
position); the lowest is popped and merged in a linked list until none is left. The count is the
number of bytes less the number of merges; no identifiers are made. Counts equal those of the
``tokenizers`` library for the same vocabulary file, whose special strings count one each.

Cases: null text counts as empty (0 bytes, 0 tokens); repeated rows are counted each; null ids
stay null; an empty table gives an empty table; long texts are counted whole, in bounded slices.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from farpoint.llm.common import CACHE_WORDS, byte_lengths, flat_words, keep, pick, row_sums, ship, slices, texts_of, tidy

#: The public pre-tokenisation pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space that more white space or the end follows: such texts are cut with more care.
LOOSE = r" (?:[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)"
#: A match of PATTERN always starts at a space before one of these, so a text may be cut there.
SAFE_CUT = re.compile(r"(?= [!-~À-ɏ])")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeCounter:
    """Counts tokens of texts for one vocabulary file; keeps counts of words it has seen."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        special = [t["content"] for t in model["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.letters = byte_letters()
        self.pieces: dict[str, int] = {}
        self.units: dict[str, int] = {}

    def merge(self, piece: str) -> int:
        """Tokens of one piece."""
        symbols = [self.letters[b] for b in piece.encode("utf-8")]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := self.ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merged = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one side has merged since
            symbols[i], symbols[j] = left + right, ""
            merged += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := self.ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (r := self.ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return n - merged

    def unit(self, text: str) -> int:
        """Tokens of a stretch without special strings that may be counted by itself."""
        got = self.units.get(text)
        if got is None:
            got = 0
            for p in self.pattern.findall(text):
                c = self.pieces.get(p)
                if c is None:
                    c = self.merge(p)
                    if len(p) <= 64:
                        self.pieces[p] = c
                got += c
            if len(text) <= 64:
                self.units[text] = got
            if len(self.units) + len(self.pieces) > 2 * CACHE_WORDS:
                self.units.clear()
                self.pieces.clear()
        return got

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if self.special is None:
            return sum(map(self.unit, SAFE_CUT.split(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.unit(u) for p in parts for u in SAFE_CUT.split(p) if u)

    def count_all(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text. Words between single spaces are counted once per distinct word."""
        loose = pc.match_substring_regex(texts, LOOSE)
        if self.special is not None:
            loose = pc.or_(loose, pc.match_substring_regex(texts, self.special.pattern))
        loose = loose.to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(~loose), texts, pa.scalar("", pa.string()))
        index, words, offsets = flat_words(pc.split_pattern(plain, " "))
        first = np.zeros(len(index), dtype=bool)
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        names = words.to_pylist()
        tables = []
        for lead, wanted in ((" ", index[~first]), ("", index[first])):
            table = np.zeros(len(names), dtype=np.int64)
            for i in np.flatnonzero(np.bincount(wanted, minlength=len(names))).tolist():
                table[i] = self.unit(lead + names[i])
            tables.append(table)
        out = row_sums(np.where(first, tables[1][index], tables[0][index]), offsets)
        for i in np.flatnonzero(loose).tolist():
            out[i] = self.count(texts[i].as_py())
        return out


_COUNTERS: dict[str, MergeCounter] = keep(__name__)


def counter(path: str) -> MergeCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row. ``path``: a byte-level BPE vocabulary on each executor."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path or default_path())
        for batch in batches:
            for part in slices(batch):
                n = count.count_all(texts_of(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(byte_lengths(part.column("text"))), pa.array(n), pa.array(n > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return pick(df, doc_id=id_col, text=text_col).mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
