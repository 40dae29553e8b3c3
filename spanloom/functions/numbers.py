"""Numeric functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def exclusive_quartile(values: Column, k: int) -> Column:
    """Quartile k of an array by the exclusive method: place k * (n + 1) / 4, clamped to the ends, between neighbours."""
    ordered = F.array_sort(F.transform(values, lambda x: x.cast("double")))
    n = F.size(values)
    j = F.least(F.greatest(F.floor(F.lit(k) * (n + 1) / 4).cast("int"), F.lit(1)), n - 1)
    rest = F.lit(k) * (n + 1) - j * 4
    return (F.get(ordered, j - 1) * (4 - rest) + F.get(ordered, j) * rest) / 4


def exclusive_iqr(values: Column) -> Column:
    """Difference of the outer exclusive quartiles; null for fewer than four values."""
    return F.when(F.size(values) >= 4, exclusive_quartile(values, 3) - exclusive_quartile(values, 1))


def variation(mean: Column, deviation: Column) -> Column:
    return F.when(mean != 0, deviation / mean)


def entropy_bits(counts: Column) -> Column:
    """Entropy in bits of an array of counts; 0 for none."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    part = F.aggregate(counts, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.log2(x / total)).otherwise(0.0))
    return F.when(total > 0, part).otherwise(F.lit(0.0))


def softmax(score: Column, over: WindowSpec, temperature: float = 1.0) -> Column:
    """Shifted by the largest score; a temperature of 0 or below counts as 1."""
    t = temperature if temperature > 0 else 1.0
    power = F.exp((score - F.max(score).over(over)) / t)
    return power / F.sum(power).over(over)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))
