"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farpoint.llm import (
    audio, jaccard_join, language_id, licenses, mixing, packing, secrets, sql, token_counts, topk_search, toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, d: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, d, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in secrets.KINDS if k != "guess"], F.sha2(text(F.filter("found", lambda x: x["kind"] != "guess")), 256).alias("base_sha256"),
        text(F.col("found")).alias("spans"), count("guess"),
    )


def op2_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_join.join(table(spark, d, "documents"))


def op3_topk_search(spark: SparkSession, d: str) -> DataFrame:
    return topk_search.top_k(table(spark, d, "embeddings"))


def op4_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, d, "documents"))


def op5_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, d, "labels")))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op7_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op6_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def op8_licenses(spark: SparkSession, d: str) -> DataFrame:
    found = licenses.find_licenses(table(spark, d, "documents"))
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["coverage"])), F.lit(0.0))
    return found.select("doc_id", F.size("found").cast("long").alias("n_licenses"), best.alias("best_coverage"), spans.alias("spans"))


def op9_audio(spark: SparkSession, d: str) -> DataFrame:
    """The tables hold no recordings, so every vector is played as one; see audio.render."""
    found = audio.match(audio.render(table(spark, d, "embeddings"), "vec_id", "embedding"))
    return found.withColumnRenamed("id", "vec_id")


def op10_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_secrets": op1_secrets, "op2_jaccard_join": op2_jaccard_join,
        "op3_topk_search": op3_topk_search, "op4_token_counts": op4_token_counts,
        "op5_toxicity": op5_toxicity, "op7_language_id": op7_language_id, "op6_packing": op6_packing, "op8_licenses": op8_licenses, "op9_audio": op9_audio, "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": sql.JACCARD_JOIN, "op3_topk_search": sql.TOPK_SEARCH}
