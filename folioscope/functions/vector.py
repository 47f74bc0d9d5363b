"""Vectors as Column expressions: dot product, norm, scores, and a check of dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """In double precision; null if the lengths differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def normalised(a: Column) -> Column:
    """Unit vector in double precision; an error for a zero vector."""
    return F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.raise_error(F.lit("zero vector")).cast("array<double>")))[0]


def checked(a: Column, dimension: int) -> Column:
    """``a``, or an error if it has another length."""
    return F.when(F.size(a) == dimension, a).otherwise(F.raise_error(F.format_string("expected %d dimensions, found %d", F.lit(dimension), F.size(a))))


def score(cosine: Column) -> Column:
    """Cosine as a score from 0 to 1."""
    return (F.lit(1.0) + cosine) / 2
