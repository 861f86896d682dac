"""Vectors as arrays of floats; sums are taken in double. Vectors of unequal length, or null, give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + x)


def _d(x: Column) -> Column:
    return x.cast("double")


def _same(a: Column, b: Column, out: Column) -> Column:
    return F.when(F.size(a) == F.size(b), out)


def vector(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def vector_extract(v: Column) -> Column:
    return F.to_json(v)


def dims(v: Column) -> Column:
    return F.size(v)


def dot(a: Column, b: Column) -> Column:
    return _same(a, b, _sum(F.zip_with(a, b, lambda x, y: _d(x) * _d(y))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: _d(x) * _d(x))))


def distance_l2_squared(a: Column, b: Column) -> Column:
    return _same(a, b, _sum(F.zip_with(a, b, lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y)))))


def distance_l2(a: Column, b: Column) -> Column:
    return F.sqrt(distance_l2_squared(a, b))


def distance_dot(a: Column, b: Column) -> Column:
    return -dot(a, b)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 if a vector has no length; between -1 and 1."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), n))))


def distance_cos(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: _d(x) / n)).otherwise(F.transform(a, _d))


def add(a: Column, b: Column) -> Column:
    return _same(a, b, F.zip_with(a, b, lambda x, y: _d(x) + _d(y)))


def subtract(a: Column, b: Column) -> Column:
    return _same(a, b, F.zip_with(a, b, lambda x, y: _d(x) - _d(y)))


def scale(a: Column, k: float) -> Column:
    return F.transform(a, lambda x: _d(x) * k)


def hamming(a: Column, b: Column, threshold: float = 0.5) -> Column:
    """Positions on different sides of the threshold."""
    return _same(a, b, F.size(F.filter(F.zip_with(a, b, lambda x, y: (x > threshold) != (y > threshold)), lambda x: x)))


def hamming_packed(a: Column, b: Column) -> Column:
    """Bits that differ between arrays of integers."""
    return _same(a, b, F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x))


def score(distance: Column, metric: str) -> Column:
    """A distance as a score that grows with likeness."""
    return {"cos": 1 - distance, "l2": 1 / (1 + distance), "dot": -distance, "hamming": 1 / (1 + distance)}[metric]


def quantize_int8(a: Column) -> Column:
    """A struct of codes (-128 to 127), scale and zero: x is about (code + 128) * scale + zero."""
    lo, hi = F.array_min(a).cast("double"), F.array_max(a).cast("double")
    step = F.when(hi > lo, (hi - lo) / 255.0).otherwise(F.lit(1.0))
    codes = F.transform(a, lambda x: (F.round((_d(x) - lo) / step) - 128).cast("tinyint"))
    return F.struct(codes.alias("codes"), step.alias("scale"), lo.alias("zero"))


def dequantize(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: (c.cast("double") + 128) * q["scale"] + q["zero"])


METRICS = {"cos": distance_cos, "l2": distance_l2, "dot": distance_dot}
