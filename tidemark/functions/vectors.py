"""Vector functions over arrays and maps of weights, in the JVM; sums run in the order of the array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; arrays of different length give null."""
    summed = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), summed)


def normalized(a: Column) -> Column:
    """The vector divided by its length; null for a zero vector."""
    length = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - inner product of unit vectors, clipped to [0, 2], as a float: exact comparisons are made on that."""
    return (1 - F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b)))).cast("float")


def sparse_dot(a: Column, b: Column) -> Column:
    """Sum of products over the keys that two maps share."""
    shared = F.filter(F.map_keys(a), lambda k: F.map_contains_key(b, k))
    return F.aggregate(shared, F.lit(0.0), lambda acc, k: acc + F.element_at(a, k) * F.element_at(b, k))
