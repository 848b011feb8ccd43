"""Scalar expressions: the error function and distance metrics."""

from farpoint.functions.erf import erf_sql, erf_column
from farpoint.functions.metrics import METRICS, distance_sql

__all__ = ["METRICS", "distance_sql", "erf_column", "erf_sql"]
