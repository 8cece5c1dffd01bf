"""Column functions over vectors (arrays of floats), summed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is next to nothing, or the result is not a number."""
    length = norm(a) * norm(b)
    value = F.when((norm(a) < TINY) | (norm(b) < TINY), 0.0).otherwise(F.try_divide(dot(a, b), length))
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))
