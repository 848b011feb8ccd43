"""A pipeline over ``documents`` of five stages, each one of the operators of farpoint.llm.

A stage takes (spark, docs, sf_dir) and returns the columns of documents, but for the last,
which returns packed pieces. Stages rely on no state besides their input and the tables.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farpoint.llm import jaccard_join, mixing, packing, secrets, toxicity

#: No SQL can express the stages; their tests compare with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; the classifier is fitted on the labels of this input."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest id stays, once."""
    joined = jaccard_join.checkpoint(jaccard_join.join(docs))
    again = joined.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"), F.min("component_id").alias("component_id"))
    gone = again.filter("doc_id <> component_id").select("doc_id")
    if gone.count() <= jaccard_join.SMALL:
        gone = F.broadcast(gone)
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    if again.filter("c > 1").isEmpty():
        return kept
    named = kept.filter("doc_id is not null").dropDuplicates(["doc_id"])
    return named.unionByName(kept.filter("doc_id is null"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars, where there is one, follows."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents that it leaves out go."""
    own = {c: f"c{i}_" for i, c in enumerate(docs.columns)}  # whatever the columns are called
    mixed = mixing.mix(docs.withColumnsRenamed(own), own["doc_id"], own["text"], own["source"], keep=list(own.values()))
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    copies = mixed.withColumn("copy_", F.explode(F.array_repeat(F.lit(0), times)))
    return copies.select([F.col(n).alias(c) for c, n in own.items()])


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces packed from ``documents``; every stage is written as Parquet and read again."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="pipeline")
    base = os.path.join(shared, f"pipeline_{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
