"""Vector functions on arrays, in double precision."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda t, v: t + v)


def cosine(x: Column, y: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    size = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(size > 0, dot(x, y) / size).otherwise(0.0)
