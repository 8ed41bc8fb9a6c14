"""Cross-products and covariances of vector columns."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadic.functions import columns as C


def vector_width(df: DataFrame, vector: str) -> int:
    """Common length of the vectors; different lengths raise."""
    widths = df.agg(F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("b")).first()
    if widths["a"] != widths["b"]:
        raise ValueError(f"vectors of different length: {widths['a']} to {widths['b']}")
    return widths["a"] or 0


def vector_mean(df: DataFrame, by: list[str], vector: str = "z", out: str = "centroid", d: int | None = None) -> DataFrame:
    """Mean vector per group, one partially aggregated average per component."""
    d = vector_width(df, vector) if d is None else d
    return df.groupBy(*by).agg(C.vector_aggregate("avg", vector, d).alias(out), F.count(F.lit(1)).alias("n"))


def cross_product(vectors: DataFrame, vector: str = "z") -> np.ndarray:
    """Sum of outer products of the row vectors, summed over a tree of executors."""
    dense = vectors.select(array_to_vector(F.col(vector)).alias("v"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(dense, "v")).computeGramianMatrix().toArray()


def covariance(vectors: DataFrame, vector: str = "z") -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and population covariance of the vectors."""
    d = vector_width(vectors, vector)
    row = vector_mean(vectors, [], vector, "m", d).first()
    mean = np.array(row["m"])
    centred = vectors.select(F.zip_with(vector, C.literal_vector(mean), lambda a, b: a - b).alias("c"))
    return row["n"], mean, cross_product(centred, "c") / max(row["n"], 1)
