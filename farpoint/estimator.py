"""LoOP as a pyspark.ml Estimator, and its fitted Model."""

from __future__ import annotations

import json
import warnings

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farpoint import streaming
from farpoint.errors import ValidationError
from farpoint.operators import knn, scoring
from farpoint.operators.validate import check_extent, check_points, clamp_neighbours, feature_names, profile, to_points


class LoOP(Estimator):
    """Local Outlier Probabilities of a DataFrame of points or, with ``edges=True``, of neighbour edges.

    Points need an id, numeric features (columns, one array or one ML vector) and optionally a
    cluster column. Edges need id, nid, dist and optionally cluster; a missing distance may be
    NULL or NaN. extent outside 1..3 warns; n_neighbors <= 0 or >= rows is replaced with a warning.
    """

    featureCols = Param(Params._dummy(), "featureCols", "feature columns, or one array or vector column")
    idCol = Param(Params._dummy(), "idCol", "column of unique ids")
    clusterCol = Param(Params._dummy(), "clusterCol", "column of clusters, or None")
    extent = Param(Params._dummy(), "extent", "1, 2 or 3 standard deviations")
    nNeighbors = Param(Params._dummy(), "nNeighbors", "number of neighbours")
    strategy = Param(Params._dummy(), "strategy", "auto, sql or block")
    metric = Param(Params._dummy(), "metric", "name of the metric")
    edges = Param(Params._dummy(), "edges", "whether rows are neighbour edges")

    def __init__(self, features: list[str] | None = None, id_col: str = "id", cluster_col: str | None = None, extent: int = 3,
                 n_neighbors: int = 10, strategy: str = "auto", metric: str = "euclidean", edges: bool = False):
        super().__init__()
        if edges == bool(features):
            raise ValidationError("either features or edges must be given, not both")
        if strategy not in ("auto", "sql", "block"):
            raise ValidationError(f"unknown strategy {strategy}")
        if not isinstance(n_neighbors, int) or not isinstance(extent, int) or not (features is None or isinstance(features, (list, tuple))):
            raise ValidationError("n_neighbors and extent are integers, features a list of column names")
        self._set(featureCols=features, idCol=id_col, clusterCol=cluster_col, extent=extent, nNeighbors=n_neighbors, strategy=strategy, metric=metric, edges=edges)
        check_extent(extent)

    features = property(lambda self: self.getOrDefault("featureCols"))
    id_col = property(lambda self: self.getOrDefault("idCol"))
    cluster_col = property(lambda self: self.getOrDefault("clusterCol"))
    n_neighbors = property(lambda self: self.getOrDefault("nNeighbors"))

    def _set(self, **values) -> "LoOP":
        for name, value in values.items():  # None is a value here
            self._paramMap[self.getParam(name)] = value
        return self

    def _fit(self, df: DataFrame) -> "LoOPModel":
        return self._fit_edges(df) if self.getOrDefault("edges") else self._fit_points(df)

    def _fit_points(self, df: DataFrame) -> "LoOPModel":
        points = to_points(df, self.id_col, self.features, self.cluster_col)
        p = profile(points)
        k = clamp_neighbours(self.n_neighbors, p.rows)
        check_points(p, k)
        edges = knn.knn_edges(points, k, p.pairs, p.rows, self.getOrDefault("strategy"), self.getOrDefault("metric"))
        extent = self.getOrDefault("extent")
        return LoOPModel(scoring.score_edges(edges, k, extent, p.clusters), points, k, extent, p.clusters, self.features, self.id_col)

    def _fit_edges(self, df: DataFrame) -> "LoOPModel":
        cluster = F.col(self.cluster_col) if self.cluster_col else F.lit(0)
        dist = F.coalesce(F.col("dist").cast("double"), scoring.nan())
        edges = df.select(F.col(self.id_col).alias("id"), cluster.alias("cluster"), "nid", dist.alias("dist"), (dist * dist).alias("d2")).persist()
        per = edges.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("cluster").alias("cluster"), F.max("cluster").alias("last"))
        shape = per.agg(F.count(F.lit(1)), F.min("n"), F.max("n"), F.count_distinct("cluster"), F.count_if(F.col("cluster") != F.col("last"))).first()
        rows = shape[0]
        k = clamp_neighbours(self.n_neighbors, rows)
        if rows and shape[1] != shape[2]:
            raise ValidationError("rows have different numbers of edges")
        if rows and shape[1] != k:
            raise ValidationError(f"rows have {shape[1]} edges, n_neighbors is {k}")
        if shape[4]:
            raise ValidationError(f"{shape[4]} ids have edges in more than one cluster")
        if not edges.join(per.select(F.col("id").alias("nid")), "nid", "left_anti").isEmpty():
            raise ValidationError("some edges lead to rows that have none")
        smallest = per.groupBy("cluster").count().agg(F.min("count")).first()[0] or 0
        from farpoint.operators.validate import Profile

        check_points(Profile(rows, shape[3], smallest, 0, 0, 0), k, features=False)
        extent = self.getOrDefault("extent")
        return LoOPModel(scoring.score_edges(edges, k, extent, shape[3]), None, k, extent, shape[3], None, self.id_col)


class LoOPModel(Model):
    """Scores of the training rows, the training points, and two numbers."""

    def __init__(self, scores: DataFrame, points: DataFrame | None, k: int, extent: int, clusters: int, features: list[str] | None, id_col: str, stats: tuple[float, float] | None = None):
        super().__init__()
        self.scores, self.points, self.k, self.extent = scores, points, k, extent
        self.clusters, self.features, self.id_col, self._stats = clusters, features, id_col, stats

    @property
    def stats(self) -> tuple[float, float]:
        """(mean ev, max nplof), computed once."""
        if self._stats is None:
            r = scoring.model_stats(self.scores).first()
            self._stats = (r["mean_ev"], r["max_nplof"])
        return self._stats

    def matrix(self) -> np.ndarray:
        """The training points, for broadcast; the caller checks their size first."""
        t = self.points.select(feature_names(self.points)).toArrow()
        return np.column_stack([c.to_numpy() for c in t.columns]).astype(float, copy=False)

    def release(self) -> None:
        """Frees what fitting keeps in storage."""
        scoring.release(self.scores)

    def _transform(self, df: DataFrame) -> DataFrame:
        """df with score, in place of a column of that name. Training clusters are ignored, with a warning, as new rows have none.

        A streaming df needs training points within the broadcast bound. A larger batch is
        joined by blocks and needs the id column.
        """
        if self.clusters > 1:
            warnings.warn("the model was fitted in clusters; new rows are scored against all of them together", UserWarning, stacklevel=3)
        if self.points is None:
            return streaming.score_distances(df, "dist", self.k, self.extent, *self.stats)
        feats = feature_names(self.points)
        new = to_points(df, self.id_col, self.features) if not df.isStreaming and self.features and len(self.features) != len(feats) else None
        names = self.features if new is None else feats
        rows = self.points.count()
        source = df if new is None else new.drop("cluster")
        if df.isStreaming or rows * len(feats) * 8 <= streaming.BROADCAST_BYTES:
            return streaming.score_by_broadcast(source, names, self.matrix(), self.k, self.extent, *self.stats)
        return streaming.score_by_blocks(source, names, self.points, feats, self.k, self.extent, *self.stats)

    def save(self, path: str) -> None:
        """Parquet for scores and points, one JSON line for the rest, by Spark's writers."""
        self.scores.write.mode("overwrite").parquet(f"{path}/scores")
        if self.points is not None:
            self.points.write.mode("overwrite").parquet(f"{path}/points")
        meta = {"k": self.k, "extent": self.extent, "clusters": self.clusters, "features": self.features, "id_col": self.id_col, "stats": self.stats, "points": self.points is not None}
        self.scores.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "LoOPModel":
        m = json.loads(spark.read.text(f"{path}/meta").first()[0])
        points = spark.read.parquet(f"{path}/points") if m["points"] else None
        return LoOPModel(spark.read.parquet(f"{path}/scores"), points, m["k"], m["extent"], m["clusters"], m["features"], m["id_col"], tuple(m["stats"]))
