"""Secret scan: fixed patterns, and values in credential context that are costly to guess.

Base kinds are matched leftmost and without overlap over whole texts. The method adds kind
``guess``: a value after a credential word (``pwd: ...``, ``password is ...``) whose guess cost,
by dynamic programming, reaches ``min_log_guesses``. The cost of a value is the least sum, over
all ways to cut it into words, dates, repeats, keyboard walks, sequences and brute-force spans,
of the log10 guesses of the spans; each span also pays for its kind being unknown. After ``is``,
where prose is common, a value of letters or digits alone is no guess; after ``:`` and ``=`` the cost decides.

Spans are (kind, start, end) in code points, end exclusive, of the whole match (``guess``: of the
value). Cases: null text has no spans; repeated rows are scanned each; null ids stay null; an
empty table gives an empty table; texts and values are scanned whole. A ``guess`` never overlaps a
base span: a value that starts in one is left to it, and base spans further on cut it into parts.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from farpoint.llm.common import pick, ship, slices, tidy

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credentials?)"""
    r"""["']?[\x20\t]*(?:[:=]{1,2}>?|(?P<prose>\bis\b))[\x20\t]*["']?(?P<value>[!#-&(-~]{6,})""", re.I | re.A,
)
#: RE2 forms of the above that a text must match to be scanned in Python at all.
MAY_ASSIGN = r"""(?i)(?:passwo?r?d|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}"""
MAY_ACCESS = r"AKIA[A-Z0-9]{14}"
MAY_HEX = r"[0-9a-f]{16}"
MAY_CONTEXT = r"""(?i)(?:pass|pwd|pin|secret|token|key|auth|credential)[a-z]*["']?[\x20\t]*(?:[:=]{1,2}>?|is\b)[\x20\t]*["']?[!#-&(-~]{6}"""

# Words that guessers try first, in order of rank.
COMMON = (
    "password 123456 qwerty admin letmein welcome monkey dragon master login abc123 iloveyou sunshine princess football "
    "baseball shadow superman michael jordan trustno1 hello freedom whatever secret token user test guest root pass "
    "default changeme example sample demo temp null none true false your my the and for with from that this have here "
    "love star summer winter spring autumn monday friday january december house world black white green orange computer "
    "internet server database system access key private public api client account service config production staging"
).split()
# Rows of the usual keyboard.
KEYBOARD = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("430157$@!", "aeoistsai")


def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for r, row in enumerate(KEYBOARD):
        for c, ch in enumerate(row):
            near[ch] = {KEYBOARD[y][x] for y in range(max(0, r - 1), min(len(KEYBOARD), r + 2)) for x in (c - 1, c, c + 1) if 0 <= x < len(KEYBOARD[y])} - {ch}
    return near


NEAR = _neighbours()
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d|(?:19|20)\d\d)")
#: log10 of the kinds a guesser must try for each span.
KIND_COST = math.log10(6)
#: Characters after which a cost is first compared with what is enough, and then again.
LOOK = 64


def guess_cost(value: str, words: tuple[str, ...] | list[str] = tuple(COMMON), enough: float = math.inf) -> tuple[float, list[tuple[str, int, int]]]:
    """(log10 of guesses, [(kind, start, end)]) of the cheapest cut of ``value``.

    Once every cut is certain to cost ``enough``, the sum stops: (what is certain, no spans).
    """
    n, ranks = len(value), {w: i + 1 for i, w in enumerate(words)}
    longest = max(map(len, ranks), default=0)
    low = value.lower()
    plain = low.translate(LEET)
    size = sum(k for k, p in ((26, r"[a-z]"), (26, r"[A-Z]"), (10, r"\d"), (33, r"[^a-zA-Z0-9]")) if re.search(p, value)) or 1
    # how far a repeat, a sequence or a walk that ends at i reaches back
    same, step, walk = [1] * n, [1] * n, [1] * n
    for i in range(1, n):
        same[i] = same[i - 1] + 1 if value[i] == value[i - 1] else 1
        d = ord(value[i]) - ord(value[i - 1])
        if abs(d) == 1:
            step[i] = step[i - 1] + 1 if i > 1 and d == ord(value[i - 1]) - ord(value[i - 2]) else 2
        walk[i] = walk[i - 1] + 1 if low[i] in NEAR.get(low[i - 1], ()) else 1
    ends: dict[int, list[int]] = {}
    for s in range(n):
        if value[s].isdigit() and (m := DATE.match(value, s)):
            ends.setdefault(m.end(), []).append(s)
    best, cut = [0.0] * (n + 1), [("", 0)] * (n + 1)
    brute = math.log10(size)
    for e in range(1, n + 1):
        # a brute-force span pays its kind once: growing it by one costs one more character
        grow = 0.0 if cut[e - 1][0] == "brute" else KIND_COST
        options = [(best[e - 1] + brute + grow, "brute", cut[e - 1][1] if not grow else e - 1)]
        for s in range(max(0, e - longest), e - 2):
            for text in {low[s:e], plain[s:e]}:
                if (r := ranks.get(text)) is not None:
                    forms = (value[s:e] != value[s:e].lower()) + (text != low[s:e])
                    options.append((best[s] + math.log10(r) + 0.6 * forms + KIND_COST, "word", s))
        for k, kind, price in ((same[e - 1], "repeat", brute), (step[e - 1], "sequence", brute + 0.3), (walk[e - 1], "walk", brute + 0.8)):
            if k >= 3:
                options.append((best[e - k] + price + math.log10(k) + (0.5 * k if kind == "walk" else 0) + KIND_COST, kind, e - k))
        for s in ends.get(e, []):
            options.append((best[s] + math.log10(365 * 120) + KIND_COST, "date", s))
        best[e], kind, s = min(options)
        cut[e] = (kind, s)
        if e % LOOK == 0 and e < n:
            # every cut of the whole has a bound here or a span across, from one of these starts
            certain = min(*best[max(0, e - max(longest, 10)) : e + 1], *(best[e - back[e - 1]] for back in (same, step, walk)))
            if certain >= enough:
                return certain, []
    spans, e = [], n
    while e:
        kind, s = cut[e]
        spans.append((kind, s, e))
        e = s
    return best[n], spans[::-1]


def classes(value: str) -> set[str]:
    """Kinds of characters: a single kind is as likely a plain word or number after "is"."""
    return {"letter" if c.isalpha() else "digit" if c.isdigit() else "sign" for c in value}


def scan(text: str, min_log_guesses: float = 9.0, min_length: int = 8, words=tuple(COMMON)) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then by kind as listed."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= 16]
    base = sorted(x[1:] for x in found)
    for m in CONTEXT.finditer(text):
        s = m.start("value")
        e = s + len(m["value"].rstrip(".,;:!?)]}>"))
        inside = [(a, b) for a, b in base if a < e and s < b]
        if inside and inside[0][0] <= s:
            continue
        if e - s >= min_length and (not m["prose"] or len(classes(text[s:e])) > 1) and guess_cost(text[s:e], words, min_log_guesses)[0] >= min_log_guesses:
            for a, b in [*inside, (e, e)]:
                if a > s:
                    found.append(("guess", s, a))
                s = max(s, b)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def may_hold(texts: pa.Array) -> np.ndarray:
    """Texts that can hold a span; a fast scan outside Python."""
    hit = np.zeros(len(texts), dtype=bool)
    for p in (MAY_ASSIGN, MAY_ACCESS, MAY_HEX, MAY_CONTEXT):
        hit |= pc.fill_null(pc.match_substring_regex(texts, p), False).to_numpy(zero_copy_only=False)
    return hit


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_log_guesses: float = 9.0) -> DataFrame:
    """(doc_id, found array<struct<kind, start, end>>) for every row."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").cast(pa.string())
                found: list[list[dict]] = [[] for _ in range(len(texts))]
                for i in np.flatnonzero(may_hold(texts)).tolist():
                    found[i] = [{"kind": k, "start": s, "end": e} for k, s, e in scan(texts[i].as_py(), min_log_guesses)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, type=pa.list_(span))], names=["doc_id", "found"])

    return pick(df, doc_id=id_col, text=text_col).mapInArrow(tidy(run), f"doc_id {kind}, found array<struct<kind:string,start:bigint,end:bigint>>")


def redact(df: DataFrame, text_col: str = "text", mask: str = "[SECRET]", min_log_guesses: float = 9.0) -> DataFrame:
    """df with every span of its texts replaced by ``mask`` (overlapping spans by one); all else unchanged. Null texts stay null; whatever the other columns are called."""
    ship(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at).cast(pa.string())
                hits = np.flatnonzero(may_hold(texts))
                if len(hits):
                    values = [texts[i].as_py() for i in hits.tolist()]
                    clean = pa.array([masked(v, scan(v, min_log_guesses), mask) for v in values], type=pa.string())
                    at_hits = np.zeros(len(texts), dtype=bool)
                    at_hits[hits] = True
                    texts = pc.replace_with_mask(texts, pa.array(at_hits), clean)
                    part = part.set_column(at, part.schema.field(at), texts.cast(part.schema.field(at).type))
                yield part

    return df.mapInArrow(tidy(run), df.schema)


def masked(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    out, end = [], 0
    for _, s, e in spans:
        if s >= end:
            out += [text[end:s], mask]
        end = max(end, e)
    return "".join(out) + text[end:]


def digest(spans: list[tuple[str, int, int]]) -> str:
    """SHA-256 of the joined base spans."""
    return hashlib.sha256(joined([x for x in spans if x[0] != "guess"]).encode()).hexdigest()
