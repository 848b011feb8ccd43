"""Reading tables and turning in-memory objects into points."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the test-data layout, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """A CSV scan with a given schema; inference would read the file twice."""
    return spark.read.csv(path, schema=schema, header=header)


def write_scores(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet sink for scored rows."""
    df.write.mode(mode).parquet(path)


def rows_of(obj) -> list[list[float]]:
    """A pandas frame, ndarray, list or scalar as a list of feature rows (1-D: one feature).

    Anything but a frame or an array is taken with a warning.
    """
    kind = type(obj).__name__
    if kind not in ("DataFrame", "ndarray"):
        warnings.warn("data and matrices are best given as an ndarray or a DataFrame; this one is converted", UserWarning, stacklevel=3)
        if not isinstance(obj, (list, tuple)):
            obj = [obj]
    values = obj.to_numpy().tolist() if kind == "DataFrame" else obj.tolist() if kind == "ndarray" else list(obj)
    return [[float(v) for v in (r if isinstance(r, (list, tuple)) else [r])] for r in values]


def label_values(labels, rows: int) -> tuple[list, T.DataType]:
    """Cluster labels as plain values and their type; none given: 0 for every row."""
    values = [0] * rows if labels is None else [x.item() if hasattr(x, "item") else x for x in labels]
    kinds = {type(v) for v in values if v is not None}
    if kinds <= {int}:
        return values, T.LongType()
    if kinds <= {int, float}:
        return [None if v is None else float(v) for v in values], T.DoubleType()
    return [None if v is None else str(v) for v in values], T.StringType()


def points_from(spark: SparkSession, obj, labels=None) -> DataFrame:
    """(id = row position, f0.., cluster) from an in-memory object; small data only."""
    rows = rows_of(obj)
    labels, kind = label_values(labels, len(rows))
    width = len(rows[0]) if rows else 1
    schema = T.StructType(
        [T.StructField("id", T.LongType())] + [T.StructField(f"f{i}", T.DoubleType()) for i in range(width)] + [T.StructField("cluster", kind)]
    )
    return spark.createDataFrame([(i, *r, c) for i, (r, c) in enumerate(zip(rows, labels, strict=False))], schema)


def edges_from(spark: SparkSession, distances, neighbours, labels=None) -> DataFrame:
    """(id, cluster, rank, nid, dist) from two matrices of equal shape."""
    d, n = rows_of(distances), rows_of(neighbours)
    labels, kind = label_values(labels, len(d))
    flat = [(i, labels[i], r + 1, int(x), float(v)) for i, (dv, nv) in enumerate(zip(d, n, strict=True)) for r, (v, x) in enumerate(zip(dv, nv, strict=True))]
    return spark.createDataFrame(flat, f"id long, cluster {kind.simpleString()}, rank int, nid long, dist double")
