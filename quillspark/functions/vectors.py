"""Vector expressions over array<float> columns; sums run in double, in array order."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def magnitude(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector over its length, rounded to float; a zero vector is an error, null stays null."""
    size = magnitude(a)
    return F.when(size > 0, F.transform(a, lambda x: (x.cast("double") / size).cast("float"))).when(a.isNotNull(), F.raise_error(F.lit("a zero vector has no direction")).cast("array<float>"))


def cosine(a: Column, b: Column) -> Column:
    return dot(unit(a), unit(b))
