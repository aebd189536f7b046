"""Vector expressions over arrays of numbers; all arithmetic in double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector or a null one."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def constant(v: Sequence[float]) -> Column:
    """A query vector as a literal, so the scan that it is held against needs no join."""
    return F.array(*(F.lit(float(x)) for x in v))


def l2_normalized(a: Column) -> Column:
    """``a`` by its length; a zero vector as it is."""
    n = norm(a)
    return F.when(n == 0, doubles(a)).otherwise(F.transform(doubles(a), lambda x: x / n))


def wave_embedding(text: Column, dimension: int) -> Column:
    """A deterministic stand-in for a model's vector: two waves in the text's hash, normalised."""
    from tarnforge.functions.text import rolling_hash

    h = F.abs(rolling_hash(text)).cast("double")
    wave = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: 0.3 * F.sin(0.01 * h + 0.017 * i) + 0.2 * F.cos(0.007 * h + 0.023 * i))
    return l2_normalized(wave)
