"""Vector expressions over array columns; arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 for unequal lengths and zero norms."""
    ok = F.size(as_double(a)) == F.size(as_double(b))
    return F.when(ok, F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))).otherwise(F.lit(0.0))


def is_finite(v: Column | str) -> Column:
    """Every component is present and finite."""
    return F.forall(as_double(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
