"""Vectors as arrays of floats; sums in double."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot_with(a: Column, query: list[float]) -> Column:
    """The dot product with one known vector, written out by term: no lambda, so code is generated for it."""
    return reduce(lambda s, t: s + t, (F.get(a, F.lit(i)).cast("double") * F.lit(float(q)) for i, q in enumerate(query)))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """To length 1; a vector shorter than 1e-12 is divided by that. The norm stands outside the lambda, so it is taken once a vector."""
    return F.zip_with(v, F.array_repeat(F.greatest(norm(v), F.lit(1e-12)), F.size(v)), lambda x, n: x.cast("double") / n)


def mean_of(*vectors: Column) -> Column:
    """The normalized mean of vectors of one row: a query in two languages, say."""
    total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double")), vectors)
    return normalize(F.transform(total, lambda x: x / len(vectors)))


def centroids(df: DataFrame, key: str, vector: str, unit: bool = True) -> DataFrame:
    """(key, centroid): the normalized mean of a group's vectors, each normalized before where unit.

    Sums are taken per key and position, so partial sums leave each task and no group is gathered; only the
    dimensions of a key meet at the end.
    """
    v = normalize(F.col(vector)) if unit else F.col(vector)
    each = df.where(F.col(vector).isNotNull()).select(key, F.posexplode(v).alias("_i", "_x"))
    means = each.groupBy(key, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    rows = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_v"))
    return rows.select(key, normalize(F.transform("_v", lambda x: x["_m"])).alias("centroid"))
