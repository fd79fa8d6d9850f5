"""Vector arithmetic on array columns, in double precision and without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of one length."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def is_usable(v: Column, dimension: Column) -> Column:
    """A stored vector that can be used: right length, all numbers finite, not all zero."""
    broken = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) == dimension) & ~broken & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(v: Column) -> Column:
    """The vector scaled to length one; an error if it has no direction."""
    length = norm(v)
    sound = (length > 0) & ~F.isnan(length) & (length < float("inf"))
    return F.when(sound, F.transform(doubles(v), lambda x: x / length)).otherwise(F.raise_error(F.lit("vector can't be normalised")).cast("array<double>"))


def unit_or_null(v: Column) -> Column:
    """As ``unit``, null where there is no direction."""
    length = norm(v)
    return F.when((length > 0) & ~F.isnan(length) & (length < float("inf")), F.transform(doubles(v), lambda x: x / length))


def blend(a: Column, b: Column, share: float) -> Column:
    """share * a + (1 - share) * b, scaled to length one."""
    return unit(F.zip_with(doubles(a), doubles(b), lambda x, y: x * share + y * (1 - share)))


def safe_float(value: Column, default: float = 0.0) -> Column:
    """The value as a finite double, or the default."""
    number = value.cast("string").try_cast("double")
    return F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")), F.lit(default)).otherwise(number)
