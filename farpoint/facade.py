"""A small object for in-memory data: construct, fit(), stream(x)."""

from __future__ import annotations

import warnings

import numpy as np

from pyspark.sql import SparkSession

from farpoint.errors import ValidationError
from farpoint.estimator import LoOP, LoOPModel
from farpoint.operators.validate import check_extent
from farpoint.sources import edges_from, points_from, rows_of


class LocalOutlierProbability:
    """Takes arrays, frames or lists; results come back in input order.

    use_numba, n_jobs and progress_bar are accepted and have no effect: Spark runs the tasks.
    """

    def __init__(self, data=None, distance_matrix=None, neighbor_matrix=None, extent: int = 3, n_neighbors: int = 10,
                 cluster_labels=None, use_numba: bool = False, n_jobs: int = 1, progress_bar: bool = False, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.data, self.distance_matrix, self.neighbor_matrix = data, distance_matrix, neighbor_matrix
        self.extent, self.n_neighbors, self.cluster_labels = extent, n_neighbors, cluster_labels
        self.use_numba, self.n_jobs, self.progress_bar = False, n_jobs, progress_bar
        self.is_fit, self.model = False, None
        if use_numba:
            self._warn("use_numba has no effect here")
        if n_jobs < -1 or n_jobs == 0:
            self._warn("n_jobs is neither -1 nor positive; 1 is used")
            self.n_jobs = 1
        self._valid = self._validate()
        check_extent(extent)

    @staticmethod
    def _warn(text: str) -> None:
        warnings.warn(text, UserWarning, stacklevel=3)

    def _validate(self) -> bool:
        if self.data is None and self.distance_matrix is None:
            self._warn("neither data nor a distance matrix was given")
        elif self.data is not None and self.distance_matrix is not None:
            self._warn("data and a distance matrix were both given; give one")
        elif self.data is not None:
            return True
        elif self.neighbor_matrix is None:
            self._warn("a distance matrix needs its neighbour matrix")
        else:
            shapes = [(len(m), len(m[0]) if len(m) else 0) for m in (rows_of(self.distance_matrix), rows_of(self.neighbor_matrix))]
            if shapes[0] != shapes[1]:
                self._warn("distance and neighbour matrix differ in shape")
            elif shapes[0][1] != self.n_neighbors:
                self._warn("the matrices have another number of columns than n_neighbors")
            else:
                return True
        return False

    def fit(self) -> "LocalOutlierProbability":
        if not self._valid:
            raise ValidationError("the inputs given cannot be fit")
        with warnings.catch_warnings():
            if self.extent not in (1, 2, 3):  # said already on construction
                warnings.filterwarnings("ignore", message="extent is meant")
            if self.data is not None:
                points = points_from(self.spark, self.data, self.cluster_labels)
                names = [c for c in points.columns if c not in ("id", "cluster")]
                self.model = LoOP(names, "id", "cluster", self.extent, self.n_neighbors).fit(points)
            else:
                edges = edges_from(self.spark, self.distance_matrix, self.neighbor_matrix, self.cluster_labels)
                self.model = LoOP(None, "id", "cluster", self.extent, self.n_neighbors, edges=True).fit(edges)
        rows = self.model.scores.select("id", "score", "pdist", "ev", "nplof").orderBy("id").collect()
        self.n_neighbors = self.model.k
        self.local_outlier_probabilities = [r["score"] for r in rows]
        self.prob_distances = [r["pdist"] for r in rows]
        self.prob_distances_ev = [r["ev"] for r in rows]
        self.norm_prob_local_outlier_factor = self.model.stats[1]
        self.is_fit = True
        return self

    def stream(self, x, refit: bool = False) -> float:
        """Score of one observation (matrix mode: one distance) against the fitted rows.

        After a clustered fit it warns and uses the mean ev and the largest nplof of all
        clusters; refit=True fits anew without clusters first.
        """
        clustered = self.cluster_labels is not None and len(set(self.cluster_labels)) > 1
        if clustered:
            self._warn("the fit was in clusters; a new row is scored against all of them together")
        if not self.is_fit:
            self._warn("stream before fit: fitting first")
        if not self.is_fit or clustered and refit:
            labels, self.cluster_labels = self.cluster_labels, None if clustered else self.cluster_labels
            try:
                self.fit()
            finally:
                self.cluster_labels = labels
        model: LoOPModel = self.model
        values = [v for r in rows_of(x if hasattr(x, "shape") else np.asarray(x, dtype=float).reshape(-1)) for v in r]
        if self.data is not None:
            names = model.features
            row = self.spark.createDataFrame([(0, *values)], "id long, " + ", ".join(f"{c} double" for c in names))
        else:
            row = self.spark.createDataFrame([(0, values[0])], "id long, dist double")
        return model.transform(row).first()["score"]
