"""Column expressions over vectors (arrays of numbers); all arithmetic is in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column, floor: float = 1e-12) -> Column:
    """Divided by the norm, or by ``floor`` if that is larger."""
    length = F.greatest(norm(v), F.lit(floor))
    return F.transform(doubles(v), lambda x: x / length)


def unit_or_same(v: Column, least: float = 1e-8) -> Column:
    """Divided by the norm unless it is below ``least``."""
    length = norm(v)
    return F.transform(doubles(v), lambda x: x / F.when(length < least, F.lit(1.0)).otherwise(length))


def pad_or_crop(v: Column, size: int) -> Column:
    """Zeros behind, or the middle part."""
    n = F.size(v)
    cut = F.slice(v, F.floor((n - size) / 2).cast("int") + 1, F.lit(size))
    return F.when(n >= size, cut).otherwise(F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), size - n))))


def rounded(v: Column, digits: int = 6) -> Column:
    return F.transform(v, lambda x: F.round(x, digits))


def text_form(v: Column, digits: int = 6) -> Column:
    """A vector as text of integers (values times 10**digits): to be compared across engines."""
    return F.array_join(F.transform(v, lambda x: F.round(x * 10**digits, 0).cast("bigint").cast("string")), ",")
