"""Mathematical functions with SQLite's behaviour: null where the argument lies outside the domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Halves go towards +infinity (-2.5 gives -2), unlike round()."""
    p = 10.0**digits
    return F.floor(x * p + 0.5).cast("double") / p


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def ln(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def log2(x: Column) -> Column:
    return F.when(x > 0, F.log2(x))


def log(x: Column, base: float | None = None) -> Column:
    """Natural, or to a base."""
    return ln(x) if base is None else ln(x) / F.log(F.lit(float(base)))


def mod(x: Column, y: Column) -> Column:
    """Sign of the dividend; null for 0."""
    return F.try_mod(x, y)


def asin(x: Column) -> Column:
    return F.when(x.between(-1, 1), F.asin(x))


def acos(x: Column) -> Column:
    return F.when(x.between(-1, 1), F.acos(x))


def largest(*xs: Column) -> Column:
    """max(a, b, ...), nulls left aside."""
    return F.greatest(*xs)


def smallest(*xs: Column) -> Column:
    return F.least(*xs)


def random_integer(seed: int | None = None) -> Column:
    """A signed 64-bit integer."""
    r = F.rand() if seed is None else F.rand(seed)
    return ((r - 0.5) * F.lit(2.0**64)).cast("bigint")


def number(x: Column) -> Column:
    """Text as a number where it spells one; else null."""
    return F.trim(x.cast("string")).try_cast("double")
