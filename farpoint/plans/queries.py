"""One query per operator; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farpoint.estimator import LoOP
from farpoint.functions.metrics import METRICS
from farpoint.operators import knn, recipes, scoring
from farpoint.operators.validate import cluster_sizes, missing_counts, profile, to_points
from farpoint.sources import read_table

Query = Callable[[SparkSession, str], DataFrame]
#: Metrics with a query each; the others are synonyms of manhattan.
METRIC_QUERIES = ("manhattan", "chebyshev", "canberra", "braycurtis", "hamming", "cosine")
#: Rows on one side of the pairs that a task of pairwise_distance builds.
PAIR_ROWS = 512


def r6(name: str):
    """Rounded for comparison; + 0.0 turns -0.0 into 0.0."""
    return (F.round(F.col(name), 6) + F.lit(0.0)).alias(name)


def customers(spark: SparkSession, d: str) -> DataFrame:
    return to_points(read_table(spark, d, "customer"), "c_custkey", ["c_acctbal"], "c_mktsegment")


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return to_points(read_table(spark, d, "supplier"), "s_suppkey", ["s_acctbal"])


def parts(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").cast("double").alias("p"))
    z = recipes.zscores(t, ["s", "p"], "p_brand", order="p_partkey")
    return to_points(z, "p_partkey", ["s", "p"], "p_brand")


def raw_parts(spark: SparkSession, d: str) -> DataFrame:
    return to_points(read_table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"], "p_brand")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return to_points(read_table(spark, d, "embeddings"), "vec_id", ["embedding"], "label")


def edges(points: DataFrame, k: int, metric: str = "euclidean", strategy: str = "auto") -> DataFrame:
    p = profile(points)
    return knn.knn_edges(points, min(k, p.rows - 1), p.pairs, p.rows, strategy, metric)


def pairwise_distance(spark: SparkSession, d: str) -> DataFrame:
    """All pairs: quadratic, in tasks of a bounded number of rows on one side."""
    s = suppliers(spark, d)
    a, b = s.alias("a"), s.alias("b")
    tasks = max(8, min(s.count() // PAIR_ROWS, 20_000))
    pairs = a.repartition(tasks, "id").join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.id") < F.col("b.id")))
    return pairs.select(F.col("a.id").alias("id"), F.col("b.id").alias("nid"), F.expr(METRICS["euclidean"](["a.f0"], ["b.f0"])).alias("dist")).select("id", "nid", r6("dist"))


def _edges_out(e: DataFrame) -> DataFrame:
    return e.select("id", "nid", F.col("rank").cast("long").alias("rank"), r6("d2"))


def _scores(points: DataFrame, k: int = 10, extent: int = 3, metric: str = "euclidean") -> DataFrame:
    p = profile(points)
    k = min(k, p.rows - 1)
    return scoring.score_edges(knn.knn_edges(points, k, p.pairs, p.rows, metric=metric), k, extent, p.clusters)


def _stage(columns: list[str]) -> Query:
    return lambda spark, d: _scores(customers(spark, d)).select("id", *[r6(c) for c in columns])


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Scores of customers' balances within their market segment."""
    model = LoOP(["c_acctbal"], "c_custkey", "c_mktsegment", n_neighbors=10).fit(read_table(spark, d, "customer"))
    return model.scores.select("id", "cluster", r6("score"))


def loop_extents(spark: SparkSession, d: str) -> DataFrame:
    s = scoring.score_extents(edges(customers(spark, d), 10), 10)
    return s.select(F.col("extent").cast("long").alias("extent"), "id", r6("score"))


def loop_k_ensemble(spark: SparkSession, d: str) -> DataFrame:
    return recipes.k_ensemble(edges(customers(spark, d), 20), (5, 10, 20)).select("id", r6("score"))


def loop_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """A constant feature: every score is 0."""
    s = read_table(spark, d, "supplier").select("s_suppkey", F.lit(1.0).alias("one"))
    return _scores(to_points(s, "s_suppkey", ["one"]), 3).select("id", r6("score"))


def loop_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Mostly equal values: expected distances of 0 and the value read in their place."""
    s = read_table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 == 0, F.col("s_acctbal")).otherwise(0.0).alias("x"))
    return _scores(to_points(s, "s_suppkey", ["x"]), 3).select("id", r6("pdist"), r6("ev"), r6("score"))


def matrix_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges as a caller would bring them: neighbours over all customers, clusters by segment."""
    p = customers(spark, d)
    e = edges(p.withColumn("cluster", F.lit(0)), 10)
    return e.drop("cluster").join(p.select("id", "cluster"), "id").withColumn("dist", F.sqrt("d2"))


def loop_matrix_nan(spark: SparkSession, d: str) -> DataFrame:
    """One row without distances: it has no score, and its neighbours ignore it. NaN is told as NULL."""
    e = matrix_edges(spark, d).withColumn("dist", F.when(F.col("id") % 50 == 0, float("nan")).otherwise(F.col("dist")))
    s = LoOP(None, "id", "cluster", edges=True).fit(e).scores
    return s.select("id", F.when(~F.isnan("score"), F.round("score", 6) + F.lit(0.0)).alias("score"))


def loop_matrix_cross_cluster(spark: SparkSession, d: str) -> DataFrame:
    return LoOP(None, "id", "cluster", edges=True).fit(matrix_edges(spark, d)).scores.select("id", r6("score"))


def model_stats(spark: SparkSession, d: str) -> DataFrame:
    return scoring.model_stats(_scores(customers(spark, d))).select(r6("max_nplof"), r6("mean_ev"), "rows")


def _trained(spark: SparkSession, d: str):
    train, new = recipes.split_by_key(read_table(spark, d, "customer"), "c_custkey", 5, 0)
    return LoOP(["c_acctbal"], "c_custkey", n_neighbors=10, strategy="block").fit(train), new


def stream_score(spark: SparkSession, d: str) -> DataFrame:
    model, new = _trained(spark, d)
    return model.transform(new).select(F.col("c_custkey").alias("id"), r6("score"))


def stream_score_distance(spark: SparkSession, d: str) -> DataFrame:
    """Matrix mode: each customer's balance, scaled, taken as its one distance."""
    model = LoOP(None, "id", None, edges=True).fit(matrix_edges(spark, d).drop("cluster"))
    new = read_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.abs("c_acctbal") / 1000).alias("dist"))
    return model.transform(new).select("id", r6("score"))


def stream_vs_batch_rmse(spark: SparkSession, d: str) -> DataFrame:
    model, new = _trained(spark, d)
    batch = LoOP(["c_acctbal"], "c_custkey", n_neighbors=10, strategy="block").fit(read_table(spark, d, "customer")).scores
    both = model.transform(new).select(F.col("c_custkey").alias("id"), F.col("score").alias("a")).join(batch.select("id", F.col("score").alias("b")), "id")
    return both.agg(recipes.rmse("a", "b").alias("rmse")).select(r6("rmse"))


def concat_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the training rows and of the new rows in one table."""
    model, new = _trained(spark, d)
    old = model.scores.select("id", "score", F.lit(False).alias("is_new"))
    return old.unionByName(model.transform(new).select(F.col("c_custkey").alias("id"), "score", F.lit(True).alias("is_new"))).select("id", r6("score"), "is_new")


def score_auc(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "events")
    points = to_points(t, "event_id", ["value"])
    s = scoring.score_edges(edges(points, 10, strategy="block"), 10)
    both = s.select(F.col("id").alias("event_id"), F.round("score", 9).alias("score")).join(t.select("event_id", (F.col("event_type") == "error").cast("int").alias("y")), "event_id")
    return recipes.roc_auc(both, "score", "y").select((F.round("auc", 4) + F.lit(0.0)).alias("auc"))


def structured_stream_score(spark: SparkSession, d: str) -> DataFrame:
    """The rows of stream_score, through a stream that reads what is there and ends."""
    import uuid

    model, _ = _trained(spark, d)
    source = spark.readStream.schema(read_table(spark, d, "customer").schema).option("pathGlobFilter", "customer.parquet").parquet(d)
    out = model.transform(source.filter(F.col("c_custkey") % 5 == 0)).select(F.col("c_custkey").alias("id"), r6("score"))
    name = f"scored_{uuid.uuid4().hex}"
    out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "pairwise_distance": pairwise_distance,
        "knn_edges": lambda s, d: _edges_out(edges(customers(s, d), 10)),
        "knn_edges_block": lambda s, d: _edges_out(edges(customers(s, d), 10, strategy="block")),
        "knn_edges_block_2d": lambda s, d: _edges_out(edges(raw_parts(s, d), 5, strategy="block")),
        "knn_edges_global": lambda s, d: _edges_out(edges(suppliers(s, d), 10)),
        "sum_squared_distance": _stage(["ssd"]), "standard_distance": _stage(["std_dist"]), "prob_distance": _stage(["pdist"]),
        "expected_prob_distance": _stage(["ev"]), "plof": _stage(["plof"]), "plof_ev": _stage(["plof_ev"]), "nplof": _stage(["nplof"]),
        "loop_clustered": flagship,
        "loop_wide": _stage(["ssd", "std_dist", "pdist", "ev", "plof", "plof_ev", "nplof", "score"]),
        "loop_global": lambda s, d: _scores(suppliers(s, d)).select("id", r6("score")),
        "loop_extents": loop_extents, "loop_k_ensemble": loop_k_ensemble,
        "loop_multifeature": lambda s, d: _scores(parts(s, d)).select("id", r6("score")),
        "loop_embeddings": lambda s, d: _scores(vectors(s, d)).select("id", r6("score")),
        "loop_duplicates": loop_duplicates, "loop_near_duplicates": loop_near_duplicates,
        "loop_matrix_nan": loop_matrix_nan, "loop_matrix_cross_cluster": loop_matrix_cross_cluster,
        "model_stats": model_stats, "stream_score": stream_score, "stream_score_distance": stream_score_distance,
        "stream_vs_batch_rmse": stream_vs_batch_rmse, "concat_scores": concat_scores,
        "outlier_filter": lambda s, d: recipes.above(_scores(customers(s, d)), 0.1).select("id", r6("score")),
        "outlier_topk": lambda s, d: recipes.top(_scores(customers(s, d)).select("id", r6("score")), 20),
        "attach_scores": lambda s, d: recipes.attach(read_table(s, d, "supplier"), _scores(suppliers(s, d)), "s_suppkey").select("s_suppkey", "s_name", r6("score")),
        "score_auc": score_auc,
        "cluster_sizes": lambda s, d: cluster_sizes(to_points(read_table(s, d, "events"), "event_id", ["value"], "event_type")),
        "missing_counts": lambda s, d: missing_counts(to_points(read_table(s, d, "events"), "event_id", ["value"], "event_type")),
        "structured_stream_score": structured_stream_score,
    }
    for m in METRIC_QUERIES:
        out[f"loop_metric_{m}"] = lambda s, d, m=m: _scores(raw_parts(s, d), 10, 3, m).select("id", r6("score"))
    return out
