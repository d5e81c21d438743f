"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    )


def unit(vector: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays as it is."""
    length = norm(vector)
    return F.transform(
        vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double"))
    )


def blend(old: Column, new: Column, share: float) -> Column:
    """(1 - share) * old + share * new, element by element."""
    return F.zip_with(old, new, lambda a, b: (1.0 - share) * a + share * b)
