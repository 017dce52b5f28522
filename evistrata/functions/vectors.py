"""Vector expressions over arrays, evaluated in the JVM in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if the lengths differ or an entry is null."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector at length one; null for a null or all-zero vector."""
    # The length is bound as an element of an array, else it would be computed again for every entry.
    return F.get(F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))), 0)


def cosine(a: Column, b: Column) -> Column:
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths)
