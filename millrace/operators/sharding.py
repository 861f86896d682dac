"""Which shard a row belongs to, and which shards a condition needs: hash, consistent hash and range indexes.

On Spark a shard is a value of a column that data is partitioned or bucketed by; routing is pruning on that column.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from decimal import Decimal

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StringType

from ..lake.partitioning import fnv1a
from ..plans.lexer import Token, closing, lex, name, solid, split


@dataclass
class FnvIndex:
    """shard = the public 32-bit FNV-1a hash of the key as text, modulo shards."""

    shards: int

    def shard(self, key: Column) -> Column:
        return F.pmod(fnv1a(key.cast("string")), F.lit(self.shards)).cast("int")

    def of(self, spark, value) -> int:
        return spark.range(1).select(self.shard(F.lit(str(value)))).first()[0]


@dataclass
class ListIndex:
    """Shards by lists of values; other values and nulls belong to the last shard."""

    lists: list[list] = field(default_factory=list)

    def shard(self, key: Column) -> Column:
        out = F.lit(len(self.lists))
        for k in range(len(self.lists) - 1, -1, -1):
            out = F.when(key.isin(*self.lists[k]), k).otherwise(out)
        return out

    def of(self, spark, value) -> int:
        return next((k for k, x in enumerate(self.lists) if value in x), len(self.lists))


@dataclass
class HashIndex:
    """shard = pmod(xxhash64(key as text), shards): computed by Spark and, for a literal, asked of Spark too."""

    shards: int

    def shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.shards)).cast("int")

    def of(self, spark, value) -> int:
        return spark.range(1).select(self.shard(F.lit(value))).first()[0]


@dataclass
class RingIndex:
    """Consistent hashing: each shard has so many points on a ring, a key belongs to the next point; a new shard moves few keys."""

    names: list[str]
    points: int = 150

    def __post_init__(self):
        ring = sorted((xxhash.xxh64_intdigest(f"{n}#{i}"), k) for k, n in enumerate(self.names) for i in range(self.points))
        self._at, self._who = [h for h, _ in ring], [k for _, k in ring]

    def of(self, value) -> int:
        i = bisect_left(self._at, xxhash.xxh64_intdigest(str(value)))
        return self._who[i % len(self._who)]

    def shard(self, key: Column) -> Column:
        of = self.of

        @F.pandas_udf("int")
        def f(xs: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else of(x) for x in xs], dtype="Int32")

        return f(key.cast("string"))


@dataclass
class RangeIndex:
    """shard k holds keys below bounds[k], the last shard the rest."""

    bounds: list = field(default_factory=list)

    def shard(self, key: Column) -> Column:
        out = F.lit(len(self.bounds))
        for k in range(len(self.bounds) - 1, -1, -1):
            out = F.when(key < self.bounds[k], k).otherwise(out)
        return F.when(key.isNotNull(), out)

    def between(self, lo=None, hi=None) -> list[int]:
        a = 0 if lo is None else bisect_right(self.bounds, lo)
        b = len(self.bounds) if hi is None else bisect_right(self.bounds, hi)
        return list(range(a, b + 1))


def _literal(tokens: list[Token], kind: DataType | None):
    """The value of the key's kind that tokens spell; None if they spell none, or one that only Spark can compare with the key."""
    t = solid(tokens)
    minus = len(t) == 2 and t[0].text == "-"
    if len(t) != 1 + minus:
        return None
    if t[-1].kind == "string" and not minus and (kind is None or isinstance(kind, StringType)):
        return t[0].text[1:-1].replace("''", "'")
    if t[-1].kind == "number" and (kind is None or isinstance(kind, IntegralType)):
        v = Decimal(t[-1].text) * (-1 if minus else 1)
        return int(v) if v == v.to_integral_value() else None
    return None


def _conjuncts(where: str) -> list[list[Token]]:
    """Parts of a condition that must all hold. An OR outside brackets makes it one part."""
    parts: list[list[Token]] = [[]]
    depth, between = 0, False
    for t in lex(where):
        depth += t.text == "("
        depth -= t.text == ")"
        between |= not depth and t.is_("BETWEEN")
        if not depth and t.is_("OR"):
            return []
        if not depth and t.is_("AND") and not between:
            parts.append([])
            continue
        between &= not t.is_("AND")
        parts[-1].append(t)
    return parts


def route(spark, index, where: str, key: str, kind: DataType | None = None) -> list[int] | None:
    """Shards that a condition needs: of key = v one, of key IN (...) few, of ranges those of a range index; None for all of them.

    The condition is read by tokens, so text in literals tells nothing; of parts joined by AND those that name the key and literals of its kind (whole
    numbers or text) narrow the shards, all others are left to the filter. Anything else needs all shards.
    """
    one = (lambda v: index.between(v, v)[0]) if isinstance(index, RangeIndex) else (lambda v: index.of(v)) if isinstance(index, RingIndex) else (lambda v: index.of(spark, v))
    found: set[int] | None = None
    for part in _conjuncts(where):
        p = solid(part)
        if len(p) < 3 or p[0].kind not in ("word", "quoted") or name(p[0]) != key:
            continue
        got = None
        if p[1].text in ("=", "=="):
            v = _literal(p[2:], kind)
            got = None if v is None else {one(v)}
        elif p[1].is_("IN") and p[2].text == "(" and closing(p, 2) == len(p) - 1:
            vs = [_literal(x, kind) for x in split(p[3:-1])]
            got = None if not vs or None in vs else {one(v) for v in vs}
        elif isinstance(index, RangeIndex) and p[1].text in ("<", "<=", ">", ">="):
            v = _literal(p[2:], kind)
            got = None if v is None else set(index.between(None, v) if p[1].text[0] == "<" else index.between(v, None))
        elif isinstance(index, RangeIndex) and p[1].is_("BETWEEN"):
            a = next(i for i, t in enumerate(p) if t.is_("AND"))
            lo, hi = _literal(p[2:a], kind), _literal(p[a + 1 :], kind)
            got = None if lo is None or hi is None else set(index.between(lo, hi))
        if got is not None:
            found = got if found is None else found & got
    return None if found is None else sorted(found)


def routed(df: DataFrame, index, where: str, key: str, shard: str = "shard") -> DataFrame:
    """Rows of a sharded table (partitioned by shard) under a condition; only the shards it needs are read."""
    s = route(df.sparkSession, index, where, key, df.schema[key].dataType)
    return (df if s is None else df.where(F.col(shard).isin(*s))).where(where)


def bucketed_join(left: DataFrame, right: DataFrame, key: list[str], buckets: int) -> DataFrame:
    """An inner join whose sides are first written to so many hash buckets by key: the join itself, and every later one by that key, shuffles nothing.

    Rows with a null key match nothing. Columns of equal name other than the key must be renamed before. Not for a key that holds a third of all
    rows: its bucket is one task; adaptive execution splits such keys in plain joins.
    """
    from ..lake.buckets import BucketedRuns
    from ..session import shared_path

    sides = []
    for df in (left, right):
        runs = BucketedRuns(df.sparkSession, shared_path(df.sparkSession, "bucketed"), key, buckets)
        ok = df.where(" and ".join(f"`{c}` is not null" for c in key))
        runs.write(ok.repartition(buckets, *key), "all")
        sides.append(runs.read(["all"]))
    return sides[0].join(sides[1].hint("merge"), key)
