"""Expressions on dense vectors (array columns) and on word counts."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def ratio_or_zero(top: Column, length_a: Column, length_b: Column) -> Column:
    """Cosine from its parts. A vector without length is similar to nothing: 0.
    A NaN, which would sort above every number, becomes null."""
    length = length_a * length_b
    value = F.when(length == 0, F.lit(0.0)).otherwise(F.try_divide(top, length))
    return F.nanvl(value, F.lit(None).cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float or double arrays, computed in double."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return ratio_or_zero(dot(a, b), norm(a), norm(b))
