"""Vector arithmetic on array columns, on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, different lengths or a zero norm."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0), dot(a, b) / n).otherwise(0.0)


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays. The norm is bound once, not taken for every element."""
    return F.flatten(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))))


def fused(text: Column, meta: Column, text_weight: float = 0.7, meta_weight: float = 0.3) -> Column:
    """The unit vector of the weighted sum of both unit vectors; null for different lengths."""
    total = F.zip_with(normalized(text), normalized(meta), lambda x, y: x * text_weight + y * meta_weight)
    unit = F.flatten(F.transform(F.array(total), normalized))
    return F.when(F.size(text) == F.size(meta), unit)


def synthetic(index: Column, length: int) -> Column:
    """A test vector that is a function of its index."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda d: F.round(F.sin((index + 1) * (d + 1) * 0.017) * 0.5 + 0.5, 6))
