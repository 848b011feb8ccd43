"""Chroma audio fingerprints of a media column, and their alignment.

A recording (16-bit PCM WAV bytes) becomes frames of twelve pitch-class energies. Sixteen box
filters over their integral image, each quantised to two bits, pack every position into a 32-bit
integer. Equal fingerprints form a class. Two recordings align at the offset that most of their
equal integers agree on; the share of differing bits there decides whether they match.

Candidates are classes that share ``RUN`` consecutive integers. Under such a run each class is first
compared with the run's first class; then all pairs of its classes that are not yet in one group
are, in pairs of blocks of ``BLOCK`` classes. Matches are closed transitively into groups, so these
are the groups of all candidate pairs; a passage common to many unlike recordings costs their pairs.

Cases: null, unreadable or too short recordings have an empty fingerprint and are in no class but
their own; repeated rows share a class; rows with a null id have a null class; an empty table
gives an empty table.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farpoint.llm.common import checkpoint, pick, ship
from farpoint.llm.graph import components

FRAME, HOP = 256, 64
FILTERS, WIDTH = 16, 8
RUN = 4
#: Classes of a run that one task row group holds on each side.
BLOCK = 256
#: Greatest share of differing bits of a match.
BIT_ERRORS = 0.2


def filters() -> list[tuple[int, int, int, int]]:
    """(shape, first pitch class, height, width) by rule: six shapes in turn over growing boxes."""
    return [(i % 6, (i * 5) % 12, 1 + (i * 7) % 6, 1 + (i * 3) % WIDTH) for i in range(FILTERS)]


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames x 12, each frame scaled to unit length; silent frames are 0."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    view = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    power = np.abs(np.fft.rfft(view * np.hamming(FRAME), axis=1)) ** 2
    freq = np.fft.rfftfreq(FRAME, 1 / rate)
    use = (freq >= 28) & (freq <= rate / 2.2)
    pitch = np.zeros((len(freq), 12))
    pitch[np.flatnonzero(use), np.round(12 * np.log2(freq[use] / 440.0)).astype(int) % 12] = 1
    c = power @ pitch
    norm = np.sqrt((c * c).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-3, c / np.maximum(norm, 1e-3), 0.0)


def boxes(image: np.ndarray, t: np.ndarray, y0: int, y1: int, a: int, b: int) -> np.ndarray:
    """Sums over pitch classes [y0, y1) and frames [t + a, t + b), from the integral image."""
    return image[t + b, y1] - image[t + a, y1] - image[t + b, y0] + image[t + a, y0]


def respond(image: np.ndarray, t: np.ndarray, shape: int, y: int, h: int, w: int) -> np.ndarray:
    """Difference of log box sums; the box is a whole, halves or thirds, along pitch or time, or a checkerboard."""
    y1 = min(12, y + h)
    my, mt = (y + y1 + 1) // 2, (w + 1) // 2
    whole = boxes(image, t, y, y1, 0, w)
    if shape == 0:
        plus, minus = whole, np.full(len(t), (y1 - y) * w * 0.15)
    elif shape == 1:
        plus, minus = boxes(image, t, my, y1, 0, w), boxes(image, t, y, my, 0, w)
    elif shape == 2:
        plus, minus = boxes(image, t, y, y1, mt, w), boxes(image, t, y, y1, 0, mt)
    elif shape == 3:
        plus = boxes(image, t, y, my, mt, w) + boxes(image, t, my, y1, 0, mt)
        minus = whole - plus
    elif shape == 4:
        third = max(1, (y1 - y) // 3)
        plus = boxes(image, t, y + third, min(y1, y + 2 * third), 0, w)
        minus = whole - plus
    else:
        third = max(1, w // 3)
        plus = boxes(image, t, y, y1, third, min(w, 2 * third))
        minus = whole - plus
    return np.log1p(np.maximum(plus, 0)) - np.log1p(np.maximum(minus, 0))


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    """uint32 per position; two Gray-coded bits a filter, cut at -0.25, 0 and 0.25."""
    c = chroma(samples, rate)
    n = len(c) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(axis=0).cumsum(axis=1)
    t, out = np.arange(n), np.zeros(n, dtype=np.uint32)
    gray = np.array([0, 1, 3, 2], dtype=np.uint32)
    for shape, y, h, w in filters():
        out = out << np.uint32(2) | gray[np.searchsorted([-0.25, 0.0, 0.25], np.round(respond(image, t, shape, y, h, w), 9), side="right")]
    return out


def read_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """(mono samples in [-1, 1], rate); none where the bytes are not 16-bit PCM WAV."""
    try:
        with wave.open(io.BytesIO(data or b"")) as f:
            if f.getsampwidth() != 2:
                return np.zeros(0), 1
            x = np.frombuffer(f.readframes(f.getnframes()), dtype="<i2").reshape(-1, f.getnchannels())
            return x.mean(axis=1) / 32768.0, f.getframerate()
    except (wave.Error, EOFError, ValueError):
        return np.zeros(0), 1


def write_wav(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """(offset of b against a, positions compared, share of differing bits) at the peak of the offset histogram."""
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, side="left"), np.searchsorted(b[order], a, side="right")
    votes = np.zeros(len(a) + len(b), dtype=np.int64)
    for i in np.flatnonzero(hi > lo).tolist():
        votes[i - order[lo[i] : hi[i]] + len(b)] += 1
    if not votes.any():
        return 0, 0, 1.0
    off = int(votes.argmax()) - len(b)
    x, y = (a[off:], b) if off >= 0 else (a, b[-off:])
    n = min(len(x), len(y))
    return off, n, float(np.bitwise_count(x[:n] ^ y[:n]).sum()) / (32 * n)


def render(df: DataFrame, id_col: str, vector_col: str, rate: int = 2000, note: int = 80) -> DataFrame:
    """(id, media): each vector played as a WAV recording, one note per component, its pitch by the component's rank."""
    ship(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phase = 2 * np.pi * np.arange(note) / rate
        for f in frames:
            media = []
            for v in f["v"]:
                x = np.nan_to_num(np.array([0.0 if c is None else c for c in v] if v is not None else [], dtype=float), posinf=0.0, neginf=0.0)
                key = np.clip(np.floor((x - x.mean()) / (x.std() + 1e-9) * 6), -12, 12) if len(x) else x
                tone = 261.63 * 2.0 ** (key / 12)
                media.append(write_wav(0.5 * np.sin(tone[:, None] * phase).ravel(), rate) if len(x) else None)
            yield pd.DataFrame({"id": f["id"], "media": media})

    rows = pick(df, id=id_col, v=vector_col).withColumn("id", F.col("id").cast("long"))
    return rows.mapInPandas(run, "id long, media binary")


def fingerprints(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """(id, prints array<int>, digest) for every row; digest is null where there is no fingerprint."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(*read_wav(m)) for m in batch.column("media").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([f.view(np.int32) for f in found], type=pa.list_(pa.int32())), pa.array([xxhash.xxh3_128_hexdigest(f.tobytes()) if len(f) else None for f in found], type=pa.string())],
                names=["id", "prints", "digest"],
            )

    rows = pick(df, id=id_col, media=media_col).withColumn("id", F.col("id").cast("long"))
    return rows.mapInArrow(run, "id long, prints array<int>, digest string")


def unlinked(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b), a > b: all pairs of classes that share a run and are in different groups."""
    placed = keyed.join(groups, F.col("class") == F.col("node"), "left").select("run", "class", F.coalesce("root", "class").alias("root"))
    sizes = placed.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    placed = placed.join(sizes.select("run", F.ceil(F.col("n") / BLOCK).alias("blocks")), "run").withColumn("own", F.pmod(F.xxhash64("class"), "blocks"))
    x = placed.select("run", F.col("class").alias("x"), F.col("root").alias("rx"), F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    y = placed.select("run", F.col("class").alias("y"), F.col("root").alias("ry"), F.explode(F.sequence(F.lit(0).cast("long"), "own")).alias("i"), F.col("own").alias("j"))
    both = (x["run"] == y["run"]) & (x["i"] == y["i"]) & (x["j"] == y["j"]) & (F.col("rx") != F.col("ry")) & ((x["i"] < x["j"]) | (F.col("x") > F.col("y")))
    return x.join(y, both).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def match(df: DataFrame, id_col: str = "id", media_col: str = "media", bit_errors: float = BIT_ERRORS) -> DataFrame:
    """(id, n_prints, digest, class_id, group_id): class of equal fingerprints, group of aligned ones; each named by its least id."""
    prints = checkpoint(fingerprints(df, id_col, media_col))
    classes = prints.filter("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("class"), F.first("prints").alias("prints"))
    classes = checkpoint(classes)
    runs = F.transform(F.sequence(F.lit(1), F.size("prints") - RUN + 1), lambda i: F.xxhash64(F.slice("prints", i, RUN)))
    keyed = classes.filter(F.size("prints") >= RUN).select("class", F.explode(F.array_distinct(runs)).alias("run"))
    first = keyed.groupBy("run").agg(F.min("class").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    pairs = checkpoint(keyed.join(first, "run").filter("class <> first").select(F.col("class").alias("a"), F.col("first").alias("b")).distinct())

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for a, b, x, y in zip(f["a"], f["b"], f["x"], f["y"], strict=True):
                x, y = np.asarray(x, dtype=np.int32).view(np.uint32), np.asarray(y, dtype=np.int32).view(np.uint32)
                _, n, errors = align(x, y)
                if errors <= bit_errors and 2 * n >= min(len(x), len(y)):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    side = lambda key, name: classes.select(F.col("class").alias(key), F.col("prints").alias(name))
    aligned = lambda some: checkpoint(some.join(side("a", "x"), "a").join(side("b", "y"), "b").mapInPandas(check, "a long, b long"))
    links = aligned(pairs)
    rest = unlinked(keyed.join(first.select("run"), "run"), components(links)).join(pairs, ["a", "b"], "left_anti")
    groups = components(links.unionByName(aligned(rest)))
    names = classes.select("digest", "class").join(groups, F.col("class") == F.col("node"), "left").select("digest", "class", F.coalesce("root", "class").alias("root"))
    out = prints.join(names, "digest", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("class", "id"))
    return out.select("id", F.size("prints").cast("long").alias("n_prints"), "digest", own.alias("class_id"), F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("group_id"))
