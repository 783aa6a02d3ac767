"""Vector arithmetic in the JVM, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def bucket(token: Column, dim: int) -> Column:
    """Bucket of a token in the default embedding."""
    return F.conv(F.substring(F.md5(token), 1, 7), 16, 10).cast("long") % dim
