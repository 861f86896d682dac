"""Conditional functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(x: Column, kind: str) -> Column:
    """0, '', null and false are false; kind is the column's type."""
    yes = x if kind == "boolean" else (x != "" if kind == "string" else x != 0)
    return F.coalesce(yes, F.lit(False))


def iif(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(condition, yes).otherwise(no)


def decode(x: Column, *arms: Column) -> Column:
    """Value, result pairs and perhaps a default; a null never matches, unlike Spark's decode."""
    pairs, default = arms[: len(arms) // 2 * 2], arms[-1] if len(arms) % 2 else F.lit(None)
    out = default
    for v, r in reversed(list(zip(pairs[::2], pairs[1::2]))):
        out = F.when(x == v, r).otherwise(out)
    return out


def nvl2(x: Column, there: Column, missing: Column) -> Column:
    return F.when(x.isNotNull(), there).otherwise(missing)
