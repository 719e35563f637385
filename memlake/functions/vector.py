"""Vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is all zero, null where one is null."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, vector): the mean vector of each label."""
    return (
        vectors.select(label, F.posexplode(vector).alias("pos", "x"))
        .groupBy(label, "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy(label)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias(vector))
    )
