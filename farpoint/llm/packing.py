"""Sum-of-squares online packing of token sequences into windows.

An item goes to the fill level that makes the sum, over levels, of the squared count of
partly filled windows smallest; the counts stand in one level array. Full windows are emitted
at once. At most ``OPEN`` windows and one for every ``CLOSED`` full ones are open at a time: at
that bound an item goes where it fits, or else its beginning closes the window whose going lowers
the sum most, and the rest is placed in turn. Tasks pack their own partition, so nothing is
shuffled. At its end the emptiest windows are placed into the others in the same way, and the
last one is cut into windows of power-of-two lengths, so that nothing is padded.

Cases: null text packs as empty (its closing id alone); repeated rows are packed each; null ids
stay null; an empty table gives no pieces; long texts fill whole windows first.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from farpoint.llm.common import CACHE_WORDS, flat_words, keep, pick, ranges, row_sums, ship, slices, texts_of, tidy
from farpoint.llm.token_counts import byte_letters

#: Windows that may always be open, full windows for each further one, and the most that may be.
OPEN, CLOSED, MOST_OPEN = 8, 16, 2048
#: A letter of the Latin blocks and a mark behind it: by the pattern they never share a token.
LETTER_MARK = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])([.,;:!?#$%&*])"
#: A run of small letters of the first two blocks; none is changed by composing or by dropping case.
LETTERS = re.compile("[a-zß-öø-ÿ]+").fullmatch
VISIBLE = byte_letters()
COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def as_bytes(word: str) -> str:
    """A character for each UTF-8 byte, as byte-level models name them."""
    return word if word.isascii() else word.encode().decode("latin-1").translate(VISIBLE)


class WordIds:
    """Token ids by the ``tokenizers`` library, asked once per distinct word.

    Holds for vocabularies whose pattern never crosses white space and which drop it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.lower = "Lowercase" in repr(self.library.normalizer)
        self.known: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}  # words of the generation before, dropped unless met again
        added = self.library.get_added_tokens_decoder()
        self.model = self.library.model if self.runs_of_letters_are_pieces() else None
        self.mark_id, self.mark = next(((i, t.content) for i, t in sorted(added.items()) if t.special), (None, None))

    def runs_of_letters_are_pieces(self) -> bool:
        """Whether a run of LETTERS goes to the merge model as it is, byte by byte; then the steps before can be left out."""
        probe = "azßöøÿ"
        norm, pre = self.library.normalizer, self.library.pre_tokenizer
        pieces = [p for p, _ in pre.pre_tokenize_str(norm.normalize_str(probe) if norm else probe)] if pre else []
        return self.lower and pieces == [as_bytes(probe)]

    def learn(self, words: list[str]) -> None:
        """Ids of new words: runs of letters from the model, others in few calls, kept apart by a special token between them."""
        if self.model is not None:
            letters = [w for w in words if LETTERS(w)]
            tokens = [[t.id for t in self.model.tokenize(as_bytes(w))] for w in letters]
            raw, ends = np.array(list(chain.from_iterable(tokens)), dtype="<u4").tobytes(), list(accumulate(4 * len(t) for t in tokens))
            self.known.update(zip(letters, [raw[s:e] for s, e in zip([0, *ends], ends, strict=False)], strict=True))
            words = [w for w in words if not LETTERS(w)]
        if self.mark is None:
            alone, together = words, []
        else:
            alone, together = [w for w in words if "<" in w], [w for w in words if "<" not in w]
        for w, e in zip(alone, self.library.encode_batch(alone, add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, dtype="<u4").tobytes()
        for i in range(0, len(together), 1000):
            part = together[i : i + 1000]
            ids = np.array(self.library.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(ids == self.mark_id)
            raw, starts, ends = ids.tobytes(), np.append(0, 4 * (at + 1)).tolist(), np.append(4 * at, 4 * len(ids)).tolist()
            self.known.update(zip(part, [raw[s:e] for s, e in zip(starts, ends, strict=True)], strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets per text)."""
        texts = pc.replace_substring_regex(texts, LETTER_MARK, r"\1 \2")  # and case is dropped: fewer distinct words
        if self.lower:
            marked = pc.match_substring(texts, "<|")
            texts = pc.if_else(marked, texts, pc.ascii_lower(texts))
        index, words, offsets = flat_words(pc.ascii_split_whitespace(texts))
        names = words.to_pylist()
        if len(self.known) > CACHE_WORDS // 2:
            self.known, self.before = {"": b""}, self.known
        known, before = self.known, self.before
        coded = list(map(known.get, names))
        new = [(i, w) for i, w in enumerate(names) if coded[i] is None]
        known.update((w, before[w]) for _, w in new if w in before)
        self.learn([w for _, w in new if w not in before])
        for i, w in new:
            coded[i] = known[w]
        sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) // 4
        flat, starts = np.frombuffer(b"".join(coded), dtype="<u4"), np.cumsum(sizes) - sizes
        lengths = sizes[index]
        return flat[ranges(starts[index], lengths)], np.concatenate([[0], np.cumsum(row_sums(lengths, offsets))])


class Packer:
    """Windows of ``capacity`` ids. Items are (doc, start, ids, doc_tokens)."""

    def __init__(self, capacity: int = 4096, most_open: int = MOST_OPEN):
        self.capacity, self.most_open = capacity, most_open
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.windows: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.n_open, self.sequences, self.done = 0, 0, []
        self.late = 0  # ids placed at the end, out of the windows open then

    def emit(self, items: list) -> None:
        offset = 0
        for doc, start, ids, total in items:
            self.done.append((doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes()), total, self.sequences, offset))
            offset += len(ids)
        self.sequences += 1

    def level(self, size: int, fresh: bool = True) -> int | None:
        """The fill level (0: a new window) with the least growth of the sum of squares; ties to the fullest; None where none has room."""
        room = self.capacity - size + 1
        here = self.counts[:room]
        gain = 2 * self.counts[size:] + 1
        gain[-1] = 0  # a full window is no longer counted
        none = np.iinfo(np.int64).max
        cost = np.where(here > 0, gain - 2 * here + 1, none)
        cost[0] = gain[0] if fresh else none
        h = room - 1 - int(np.argmin(cost[::-1]))
        return None if cost[h] == none else h

    def take(self, level: int) -> list:
        if not level:
            return []
        self.counts[level] -= 1
        self.n_open -= 1
        return self.windows[level].pop()

    def place(self, doc, start: int, ids: np.ndarray, total: int, most: int) -> None:
        """Puts an item into windows, of which at most ``most`` are open."""
        while (h := self.level(len(ids), self.n_open < most)) is None:
            low = self.capacity - len(ids) + 1  # no window has room: the commonest level, then the fullest, is closed
            h = self.capacity - int(np.argmax(self.counts[low:][::-1]))
            room = self.capacity - h
            self.emit([*self.take(h), (doc, start, ids[:room], total)])
            start, ids = start + room, ids[room:]
        items, t = [*self.take(h), (doc, start, ids, total)], h + len(ids)
        if t == self.capacity:
            self.emit(items)
            return
        self.windows[t].append(items)
        self.counts[t] += 1
        self.n_open += 1

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for s in range(0, whole, self.capacity):
            self.emit([(doc, s, ids[s : s + self.capacity], len(ids))])
        if whole < len(ids):
            self.place(doc, whole, ids[whole:].copy(), len(ids), min(self.most_open, OPEN + self.sequences // CLOSED))

    def finish(self) -> None:
        """Places the emptiest open windows into the others, and cuts the last one to powers of two."""
        while self.n_open > 1:
            t = int(np.argmax(self.counts > 0))
            for doc, start, ids, total in self.take(t):
                self.late += len(ids)
                self.place(doc, start, ids, total, max(1, self.n_open))
        if not self.n_open:
            return
        left, at = self.take(t := int(np.argmax(self.counts > 0))), 0
        self.late += t
        for size in (1 << b for b in range(t.bit_length() - 1, -1, -1) if t >> b & 1):
            window, filled = [], 0
            while filled < size:
                doc, start, ids, n = left[at]
                part = min(size - filled, len(ids))
                window.append((doc, start, ids[:part], n))
                filled += part
                if part == len(ids):
                    at += 1
                else:
                    left[at] = (doc, start + part, ids[part:], n)
            self.emit(window)


_CODERS: dict[str, WordIds] = keep(__name__)


def coder(path: str) -> WordIds:
    if path not in _CODERS:
        _CODERS[path] = WordIds(path)
    return _CODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 2,
         capacity: int = 4096, most_open: int = MOST_OPEN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, {COLUMNS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        code, packer, id_type = coder(path or default_path()), Packer(capacity, most_open), None

        def rows() -> Iterator[pa.RecordBatch]:
            cols = list(zip(*packer.done, strict=True)) or [[] for _ in range(7)]
            packer.done = []
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], type=id_type), *[pa.array(c, type=pa.int64()) for c in cols[1:5]], pa.array([base + s for s in cols[5]], type=pa.int64()), pa.array(cols[6], type=pa.int64())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

        for batch in batches:
            id_type = batch.column("doc_id").type
            for part in slices(batch):
                ids, offsets = code.encode(texts_of(part))
                for doc, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    packer.add(doc, np.append(ids[a:b], np.uint32(end_id)))
                if packer.done:
                    yield from rows()
        packer.finish()
        if packer.done:
            yield from rows()

    return pick(df, doc_id=id_col, text=text_col).mapInArrow(tidy(run), schema)
