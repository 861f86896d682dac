"""Relational operators that Spark has no word for, composed from those it has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import durable

SMALL_SIDE = 64 * 1024 * 1024


def reference_join(fact: DataFrame, reference: DataFrame, on, how: str = "inner", most_bytes: int = SMALL_SIDE) -> DataFrame:
    """Join with a replicated reference table. It is broadcast only if the optimizer's size of it is under most_bytes; else Spark shuffles."""
    size = reference._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return fact.join(F.broadcast(reference) if int(str(size)) <= most_bytes else reference, on, how)


def version_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows that differ between two versions, with _change_type INSERT, UPDATE or DELETE; for DELETE the old row. Keys are unique in either version; null keys are equal.

    Columns are compared themselves, not by hash: Spark's hash skips nulls, so that a value that moves to another column would go unseen.
    """
    same = F.lit(True)
    for c in new.columns:
        if c not in key:
            same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    o, n = old.withColumn("__o", F.lit(1)).alias("o"), new.withColumn("__n", F.lit(1)).alias("n")
    on = F.lit(True)
    for c in key:
        on = on & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    kind = F.when(F.col("__o").isNull(), "INSERT").when(F.col("__n").isNull(), "DELETE").when(~same, "UPDATE")
    both = o.join(n, on, "full").withColumn("_change_type", kind).where("_change_type is not null")
    pick = lambda c: F.when(F.col("_change_type") == "DELETE", F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return both.select(*[pick(c) for c in new.columns], "_change_type")


def three_way_merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: list[str]) -> DataFrame:
    """Row-level merge: columns of ours, _side (base, ours, theirs, both, conflict) and _theirs (a struct, of conflicts). Deleted rows don't appear.

    A row that only one side changed is taken from it; one that both changed alike is taken once; one changed differently (or changed here and
    deleted there) is a conflict that holds our row (null if we deleted it). Keys are unique and not null.
    """
    cols = ours.columns
    side = lambda df, s: df.select(*key, F.struct(*cols).alias(s))
    m = side(base, "b").join(side(ours, "o"), key, "full").join(side(theirs, "t"), key, "full")
    same = lambda a, c: F.col(a).eqNullSafe(F.col(c))
    who = F.when(same("o", "t"), F.when(same("b", "o"), "base").otherwise("both")).when(same("b", "t"), "ours").when(same("b", "o"), "theirs").otherwise("conflict")
    m = m.withColumn("_side", who)
    row = F.when(F.col("_side") == "theirs", F.col("t")).otherwise(F.col("o"))
    m = m.withColumn("r", row).where("r is not null or _side = 'conflict'")
    return m.select(*key, *[F.col(f"r.{c}").alias(c) for c in cols if c not in key], "_side", F.when(F.col("_side") == "conflict", F.col("t")).alias("_theirs"))


def merge_sorted(inputs: list[DataFrame], order: list[Column], key: list[str] | None = None, newest_first: str | None = None) -> DataFrame:
    """Union of inputs in one order; with key and newest_first (a column), one row a key: the one where that is greatest."""
    out = inputs[0]
    for df in inputs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    if key:
        rest = [c for c in out.columns if c not in key and c != newest_first]
        out = out.groupBy(*key).agg(F.max(F.struct(newest_first, *rest)).alias("r")).select(*key, "r.*")
    return out.orderBy(*order)


def recursive_distinct(seed: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = 1000, max_rows: int = 10_000_000) -> DataFrame:
    """WITH RECURSIVE ... UNION: rows of seed and, again and again, those that step makes of the new ones and that weren't there yet.

    Each round is written to the shared folder. Raises RuntimeError beyond max_rounds or max_rows.
    """
    known = durable(seed.distinct())
    fresh, rows = known, known.count()
    for _ in range(max_rounds):
        made = step(fresh).distinct()
        on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in known.columns]
        fresh = durable(made.toDF(*known.columns).alias("a").join(known.alias("b"), on, "left_anti"))
        n = fresh.count()
        if not n:
            return known
        rows += n
        if rows > max_rows:
            raise RuntimeError(f"recursion made more than {max_rows} rows")
        known = durable(known.unionByName(fresh))
    raise RuntimeError(f"recursion didn't end in {max_rounds} rounds")


def groups_frame(df: DataFrame, partition: list[str], order: list[Column], start: int, end: int, **aggs: Callable[[], Column]) -> DataFrame:
    """Aggregates over a GROUPS frame: peer groups from start to end around the row's own. Each of aggs is a function that makes the aggregate."""
    g = df.withColumn("__g", F.dense_rank().over(W.partitionBy(*partition).orderBy(*order)))
    w = W.partitionBy(*partition).orderBy("__g").rangeBetween(start, end)
    return g.select("*", *[f().over(w).alias(k) for k, f in aggs.items()]).drop("__g")


def excluding(df: DataFrame, partition: list[str], order: list[Column], frame: tuple[int, int], exclude: str, value: str, into: str) -> DataFrame:
    """sum, count, avg, min and max of value over a ROWS frame without part of it; columns into_sum, into_count, ...

    exclude: 'current row', 'group' (the row and its peers), 'ties' (its peers only) or 'no others'. Without the current row, and without
    peers of an unbounded frame, the frame is two frames whose aggregates are combined. Only peers within a bounded frame need its rows in an array, which is as
    small as the frame.
    """
    w = W.partitionBy(*partition).orderBy(*order)
    v, (lo, hi) = F.col(value), frame
    unbounded = lo <= W.unboundedPreceding and hi >= W.unboundedFollowing
    d = df
    if exclude == "no others":
        frames = [w.rowsBetween(lo, hi)]
    elif exclude == "current row":
        frames = ([w.rowsBetween(lo, min(-1, hi))] if lo < 0 else []) + ([w.rowsBetween(max(1, lo), hi)] if hi > 0 else [])
    elif unbounded:
        d = df.withColumn("__g", F.dense_rank().over(w))
        g = W.partitionBy(*partition).orderBy("__g")
        frames = [g.rangeBetween(W.unboundedPreceding, -1), g.rangeBetween(1, W.unboundedFollowing)]
    else:
        return _excluding_peers(df, w, frame, exclude, value, into)
    own = [v] if exclude == "ties" else []
    sums, counts = [F.sum(v).over(f) for f in frames] + own, [F.count(v).over(f) for f in frames] + [F.when(x.isNotNull(), 1).otherwise(0) for x in own]
    lows, highs = [F.min(v).over(f) for f in frames] + own, [F.max(v).over(f) for f in frames] + own
    nothing = F.lit(None).cast("double")
    n = sum(counts, F.lit(0)).cast("int")
    total = F.when(n > 0, sum((F.coalesce(x.cast("double"), F.lit(0.0)) for x in sums), F.lit(0.0)))
    out = {"sum": total, "count": n, "avg": total / F.when(n > 0, n), "min": F.least(*lows, nothing), "max": F.greatest(*highs, nothing)}
    return d.select(*df.columns, *[c.alias(f"{into}_{k}") for k, c in out.items()])


def _excluding_peers(df: DataFrame, w, frame: tuple[int, int], exclude: str, value: str, into: str) -> DataFrame:
    d = df.withColumn("__n", F.row_number().over(w)).withColumn("__g", F.dense_rank().over(w))
    d = d.withColumn("__f", F.collect_list(F.struct(F.col(value).alias("v"), F.col("__n").alias("n"), F.col("__g").alias("g"))).over(w.rowsBetween(*frame)))
    keep = {"group": lambda x: x["g"] != F.col("__g"), "ties": lambda x: (x["g"] != F.col("__g")) | (x["n"] == F.col("__n"))}[exclude]
    d = d.withColumn("__v", F.filter(F.transform(F.filter("__f", keep), lambda x: x["v"]), lambda x: x.isNotNull()))
    n = F.size("__v")
    total = F.when(n > 0, F.aggregate("__v", F.lit(0).cast("double"), lambda a, x: a + x))
    out = {"sum": total, "count": n, "avg": total / F.when(n > 0, n), "min": F.array_min("__v"), "max": F.array_max("__v")}
    return d.select(*df.columns, *[c.alias(f"{into}_{k}") for k, c in out.items()])


def group_concat(value: Column, separator: str = ",", order: Column | None = None, distinct: bool = False) -> Column:
    """Texts of a group in one; nulls are skipped, a group without any gives null. Without an order the texts' own order is taken."""
    v = value.cast("string")
    if distinct:
        return F.array_join(F.when(F.size(F.collect_set(v)) > 0, F.sort_array(F.collect_set(v))), separator)
    items = F.sort_array(F.collect_list(F.when(v.isNotNull(), F.struct((order if order is not None else v).alias("o"), v.alias("v")))))
    return F.array_join(F.when(F.size(items) > 0, F.transform(items, lambda x: x["v"])), separator)


def json_group_array(value: Column, order: Column | None = None) -> Column:
    """A group's values as a JSON array, nulls too."""
    items = F.collect_list(F.struct((order if order is not None else value).alias("o"), value.alias("v")))
    return F.to_json(F.transform(F.sort_array(items), lambda x: x["v"]))


def json_group_object(key: Column, value: Column, order: Column | None = None) -> Column:
    """A group's pairs as a JSON object; of equal keys the last in the order counts (without one, the one of greatest value), null keys are skipped."""
    items = F.sort_array(F.collect_list(F.when(key.isNotNull(), F.struct(key.alias("k"), (order if order is not None else key).alias("o"), value.alias("v")))))
    last = F.filter(items, lambda x, i: F.coalesce(F.get(items, i + 1)["k"] != x["k"], F.lit(True)))
    return F.to_json(F.map_from_arrays(F.transform(last, lambda x: x["k"]), F.transform(last, lambda x: x["v"])))


def total(value: Column) -> Column:
    """A sum that is 0.0 without any value."""
    return F.coalesce(F.sum(value.cast("double")), F.lit(0.0))


def numbered(df: DataFrame, order: list[Column], into: str = "row_number", first: int = 1) -> DataFrame:
    """df with the place of each row in an order over all rows, as row_number() OVER (ORDER BY ...) counts it, without a task that sees them all.

    Rows go to sorted ranges, which are written; a row's place is its place in the range and the rows of the ranges before, of which only the numbers, one a
    range, are gathered. An order with ties should end in a key, else equal rows have their places in any order.
    """
    rows = durable(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("__id", F.monotonically_increasing_id())
    rows = rows.withColumn("__range", F.shiftright("__id", 33))
    before, total = [], 0
    for r in rows.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect():
        before.append((r[0], total))
        total += r[1]
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "__range bigint, __before bigint"))
    return rows.join(starts, "__range").select(*df.columns, (F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1) + first).alias(into))


def top_n(df: DataFrame, order: list[Column], n: int, offset: int = 0) -> DataFrame:
    """Rows offset+1 to offset+n in an order."""
    return df.orderBy(*order).offset(offset).limit(n) if offset else df.orderBy(*order).limit(n)


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], at: str, right_at: str, columns: list[str]) -> DataFrame:
    """Each left row with the columns of the last right row of equal by, at or before it; null where there is none. One shuffle, no range join."""
    pad = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns]
    payload = [c for c in left.columns if c not in (*by, at)]
    l = left.select(*by, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*payload).alias("__row"), *pad)  # noqa: E741
    r = right.select(*by, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(l.schema["__row"].dataType).alias("__row"), *columns)
    w = W.partitionBy(*by).orderBy("__at", "__side").rowsBetween(W.unboundedPreceding, 0)
    got = F.last(F.when(F.col("__side") == 0, F.struct(*columns)), ignorenulls=True).over(w)
    out = l.unionByName(r).withColumn("__got", got).where("__side = 1")
    return out.select(*by, F.col("__at").alias(at), *[F.col(f"__row.{c}").alias(c) for c in payload], *[F.col(f"__got.{c}").alias(c) for c in columns])
