"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a target of words. Whole copies of a source cover what fits; for the rest,
documents are counted by exact length, a bounded knapsack over those counts decides how many of
each length to take, and that many are chosen by a seeded hash. Only counts by length reach the
knapsack, one task per source; documents themselves are never gathered.

Choosing n of the documents of one length: a group is dealt by hash into buckets of about
``BUCKET`` rows; buckets before the cut are taken whole, and only the bucket at the cut is
ranked. So no window holds a hot group.

Cases: null text has size 0 and is never taken; a null source is a source of its own, ranked
last; null ids stay null; repeated rows count each; an empty table gives an empty table; equal
hashes are broken by id. Sources of no words have target 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farpoint.llm.common import checkpoint, ship

#: Rows of a hash bucket within one length.
BUCKET = 512
#: Words that the exact knapsack spans; what is above is covered by proportional and greedy picks.
SPAN = 1 << 16


def word_count(text_col: str):
    """Number of runs of anything but ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict, weights: tuple[float, ...], share: float, most: float) -> dict:
    """Words per source: weights repeat over sources in code-point order, null last; no target is over most * size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left = {}, share * sum(sizes.values())
    free = [s for s in order if sizes[s] > 0]
    out.update({s: 0.0 for s in order if sizes[s] <= 0})
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            out.update({s: left * weight[s] / total for s in free})
            break
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in set(over)]
    return out


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, span: int = SPAN) -> np.ndarray:
    """How many of each length to take so that the words come as near below ``budget`` as can be.

    Proportional shares first, then the longest that still fit until under ``span`` words are
    left, then a bounded knapsack over the remaining counts: each reachable sum keeps the length
    that first reached it.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total <= 0:
        return take
    if budget >= total:
        return counts.astype(np.int64).copy()
    take = np.array([int(c) * budget // total for c in counts.tolist()], dtype=np.int64)
    left = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable").tolist():
        if left < span:
            break
        n = min(int(counts[i] - take[i]), (left - span // 2) // int(lengths[i]))
        if n > 0:
            take[i] += n
            left -= n * int(lengths[i])
    reach = np.full(left + 1, -1, dtype=np.int64)
    reach[0] = len(lengths)  # nothing taken
    for i in np.argsort(lengths, kind="stable").tolist():
        n, step = int(counts[i] - take[i]), int(lengths[i])
        if n <= 0 or step > left:
            continue
        frontier = reach >= 0
        for _ in range(min(n, left // step)):
            fresh = np.zeros(left + 1, dtype=bool)
            fresh[step:] = frontier[:-step]
            fresh &= reach < 0
            if not fresh.any():
                break
            reach[fresh] = i
            frontier = fresh
        if reach[left] >= 0:
            break
    at = int(np.flatnonzero(reach >= 0)[-1])
    while at:
        i = int(reach[at])
        take[i] += 1
        at -= int(lengths[i])
    return take


def _fit(share: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["size"] > 0].sort_values("size", kind="stable")
        if not len(pdf):
            return pd.DataFrame({"s_key": [], "size": [], "n": [], "copies": [], "extra": []})
        lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        total, target = int((lengths * counts).sum()), float(pdf["target"].iloc[0])
        copies = min(int(target // total), math.ceil(share))
        extra = fit_budget(lengths, counts, int(round(target - copies * total)))
        return pd.DataFrame({"s_key": pdf["s_key"].to_numpy(), "size": lengths, "n": counts, "copies": copies, "extra": extra})
    return run


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2),
        share: float = 1.5, most: float = 2, seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row, and the columns in ``keep``.

    taken is a multiple of size, at most ``most`` times. Sources are told apart by one row each
    on the driver; a row per source is all that it holds.
    """
    spark = df.sparkSession
    ship(spark)
    extra_cols = [c for c in keep or [] if c not in ("doc_id", "size", "source_size", "target", "taken")]
    full = df.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("s"), word_count(text_col).alias("size"),
        F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h"), *[F.col(f"`{c}`").alias(f"k_{c}") for c in extra_cols],
    ).withColumn("s_key", F.when(F.col("s").isNull(), "0").otherwise(F.concat(F.lit("1"), "s")))
    rows = checkpoint(full.select("doc_id", "s", "size", "h", "s_key"))
    counts = rows.groupBy("s_key", "s", "size").agg(F.count(F.lit(1)).alias("n"))
    counts = checkpoint(counts)
    per = counts.groupBy("s_key", "s").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    known = {r["s"]: int(r["source_size"]) for r in per.collect()}
    goal = targets(known, weights, share, most)
    table = [("0" if s is None else "1" + s, known[s], float(goal[s])) for s in known]
    aims = spark.createDataFrame(table, "s_key string, source_size long, target double")
    plan = (
        counts.join(F.broadcast(aims) if len(table) <= 10_000 else aims, "s_key").groupBy("s_key")
        .applyInPandas(_fit(most), "s_key string, size long, n long, copies long, extra long")
    )
    plan = checkpoint(plan.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET)).cast("long")))
    # where a length is taken in part: its buckets, counted, give the bucket at the cut
    cut = plan.filter((F.col("extra") > 0) & (F.col("extra") < F.col("n")))
    key = ["s_key", "size"]
    counted = (
        _with_plan(rows.select(*key, "h"), cut, key, "inner").withColumn("bucket", F.pmod("h", "buckets"))
        .groupBy(*key, "bucket", "extra").agg(F.count(F.lit(1)).alias("c"))
    )
    run = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    at = counted.withColumn("before", F.coalesce(F.sum("c").over(run), F.lit(0)))
    at = at.filter((F.col("before") <= F.col("extra")) & (F.col("extra") < F.col("before") + F.col("c"))).select(*key, F.col("bucket").alias("cut"), (F.col("extra") - F.col("before")).alias("need"))
    at = checkpoint(at)
    placed = _with_plan(full if extra_cols else rows, plan, key).withColumn("bucket", F.pmod("h", F.coalesce("buckets", F.lit(1))))
    placed = placed.join(_small(at), key, "left").withColumn("edge", F.coalesce(F.col("bucket") == F.col("cut"), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("h", "doc_id"))
    ranked = placed.filter("edge").withColumn("chosen", (rank <= F.col("need")).cast("long"))
    whole = (F.col("extra") >= F.col("n")) | (F.col("bucket") < F.col("cut"))
    rest = placed.filter(~F.col("edge")).withColumn("chosen", F.coalesce(whole, F.lit(False)).cast("long"))
    out = rest.unionByName(ranked).join(F.broadcast(aims) if len(table) <= 10_000 else aims, "s_key", "left")
    taken = (F.coalesce("copies", F.lit(0)) + F.col("chosen")) * F.col("size")
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *[F.col(f"k_{c}").alias(c) for c in extra_cols])


def _small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A broadcast where the table, already written, has few rows; else a shuffle join."""
    return F.broadcast(df) if df.count() <= most else df


def _with_plan(rows: DataFrame, plan: DataFrame, key: list[str], how: str = "left") -> DataFrame:
    return rows.join(_small(plan), key, how)
