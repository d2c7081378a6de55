"""Column expressions on ``array<double>`` vectors and on floating values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    d = norm(a) * norm(b)
    return F.when(d == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(d == 0, F.lit(1.0)).otherwise(d))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where b is 0 (a plain division raises under ANSI rules)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def r6(c: Column) -> Column:
    """Rounded to 6 places, without negative zero."""
    return F.round(c, 6) + F.lit(0.0)
