"""What the operators share: shipping code, checkpoints, slicing of Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are split into words at a time.
SLICE_BYTES = 2 << 20
#: Rows of an Arrow batch, unless the session has another value than Spark's default: texts may be long.
BATCH_ROWS, BATCH_CONF, BATCH_DEFAULT = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
#: Entries that a worker's word cache holds before it starts afresh.
CACHE_WORDS = 300_000


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context, by Spark's own file server, and bounds Arrow batches."""
    if spark.conf.get(BATCH_CONF) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, BATCH_ROWS)
    sc = spark.sparkContext
    if getattr(sc, "_farpoint_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="farpoint"), "farpoint_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    sc._farpoint_shipped = True


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the checkpoint folder and reads it back: cuts lineage, survives lost executors.

    The folder is spark.checkpoint.dir; only where that is unset, as in tests, a temporary one.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete shuffles and checkpoints that nothing refers to any more; it does so after a collection only."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: What a worker keeps from task to task, by the module it belongs to.
_KEPT: dict[str, dict] = {}


def keep(owner: str) -> dict:
    """A dict that stays in a worker until a task of another module begins there."""
    return _KEPT.setdefault(owner, {})


def release() -> None:
    """Gives freed memory back to the system; workers are reused and would hold on to it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def forget_others(owner: str) -> None:
    for name, kept in _KEPT.items():
        if name != owner:
            kept.clear()


def tidy(run: Callable) -> Callable:
    """``run`` over batches, without what other modules keep in this worker, giving memory back at its end."""
    owner = run.__module__

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(owner)
        release()
        yield from run(batches)
        release()

    return tidied


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names."""
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()])


def remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; NULL ids give that of the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def byte_lengths(texts: pa.Array) -> np.ndarray:
    """UTF-8 bytes per text; 0 for null."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batch: pa.RecordBatch, text: str | int = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows of at most ``limit`` bytes of text; a longer text stands alone."""
    lengths = byte_lengths(batch.column(text))
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield batch.slice(start, len(lengths) - start)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(text).cast(pa.string()), "")


def flat_words(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(word index per word, distinct words, words before each row) of a list of words per row."""
    coded = lists.flatten().dictionary_encode()
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, np.concatenate([[0], np.cumsum(counts)])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of all ranges, one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each row's values."""
    run = np.concatenate([[0], np.cumsum(values)])
    return run[offsets[1:]] - run[offsets[:-1]]
