"""Vector algebra over arrays and over (i, j, value) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def vector_times_matrix(vector: DataFrame, entries: DataFrame) -> DataFrame:
    """Product of a vector (i, x) and a matrix (i, j, value)."""
    return entries.join(vector, "i").groupBy("j").agg(F.sum(F.col("value") * F.col("x")).alias("value"))
