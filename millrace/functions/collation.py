"""Collations as sort keys: order by key(x), and compare keys where texts are to be equal under a collation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _nocase(x: Column) -> Column:
    """ASCII letters in lower case; others stay."""
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _natural(x: Column, width: int = 20) -> Column:
    """Runs of digits compare as numbers: they are padded to a common width."""
    parts = F.regexp_extract_all(x, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), width, "0")).otherwise(p)), "")


class Collations:
    """Names and their keys. BINARY, NOCASE, RTRIM, NATURAL, UNICODE, UNICODE_CI and UNICODE_AI are there; more may be created, and those dropped again."""

    def __init__(self):
        self._keys: dict[str, Callable[[Column], Column]] = {
            "BINARY": lambda x: x, "NOCASE": _nocase, "RTRIM": lambda x: F.regexp_replace(x, r"\s+$", ""), "NATURAL": _natural,
            **{n: (lambda x, n=n: F.collate(x, n)) for n in ("UNICODE", "UNICODE_CI", "UNICODE_AI")},
        }
        self._fixed = set(self._keys)

    def create(self, name: str, key: Callable[[Column], Column]) -> None:
        if name.upper() in self._keys:
            raise ValueError(f"there is a collation {name}")
        self._keys[name.upper()] = key

    def drop(self, name: str) -> None:
        if name.upper() in self._fixed:
            raise ValueError(f"{name} can't be dropped")
        del self._keys[name.upper()]

    def key(self, name: str, x: Column) -> Column:
        if name.upper() not in self._keys:
            raise LookupError(f"no collation {name}")
        return self._keys[name.upper()](x)

    def sort(self, df: DataFrame, column: str, name: str = "BINARY", descending: bool = False, nulls_last: bool = True) -> DataFrame:
        k = self.key(name, F.col(column))
        return df.orderBy((k.desc_nulls_last() if nulls_last else k.desc_nulls_first()) if descending else (k.asc_nulls_last() if nulls_last else k.asc_nulls_first()))
