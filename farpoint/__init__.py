"""Density-based outlier scoring (Local Outlier Probabilities) as Spark DataFrame plans."""

from farpoint.errors import ClusterSizeError, FarpointError, MissingValuesError, ValidationError
from farpoint.estimator import LoOP, LoOPModel
from farpoint.facade import LocalOutlierProbability

__all__ = [
    "ClusterSizeError", "FarpointError", "LoOP", "LoOPModel", "LocalOutlierProbability",
    "MissingValuesError", "ValidationError",
]
