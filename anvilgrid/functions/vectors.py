"""Vector expressions over ARRAY<DOUBLE> columns; sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(q: Column, v: Column) -> Column:
    """Both sides normalised, with a floor of 1e-12 for the norm of v."""
    return dot(q, v) / (norm(q) * F.greatest(norm(v), F.lit(1e-12)))


def normalised(v: Column, floor: float = 1e-12) -> Column:
    """The norm is a field of its own, so that it is computed once and not for each element."""
    with_norm = F.array(F.struct(v.alias("v"), F.greatest(norm(v), F.lit(floor)).alias("norm")))
    return F.transform(with_norm, lambda s: F.transform(s["v"], lambda x: x / s["norm"]))[0]


def strictly_normalised(v: Column) -> Column:
    """Raises where the norm is at most 1e-12."""
    return F.when(norm(v) > 1e-12, normalised(v)).otherwise(F.raise_error(F.lit("a vector without length")).cast("array<double>"))


def finite(v: Column) -> Column:
    return ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def gain(target: Column, coverage: Column) -> Column:
    """max(0, coverage of the target - coverage so far), for each facet."""
    return F.zip_with(target, coverage, lambda t, c: F.greatest(F.lit(0.0), t - c))


def softmax_of(score: Column, total: Column, most: Column, scale: float) -> Column:
    return F.exp((score - most) * scale) / total
