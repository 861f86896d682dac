"""Partition transforms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def year(ts: Column) -> Column:
    return F.year(ts)


def month(ts: Column) -> Column:
    """Months as year * 12 + month, January being 0."""
    return F.year(ts) * 12 + F.month(ts) - 1


def day(ts: Column) -> Column:
    """Days since the epoch, also before it."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(86_400_000_000)).cast("bigint")


def hour(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(3_600_000_000)).cast("bigint")


def bucket(x: Column, n: int) -> Column:
    """0 to n-1 by the string's 32-bit polynomial hash of base 31, made positive; null stays null."""
    codes = F.transform(F.split(x.cast("string"), ""), lambda ch: F.ascii(ch).cast("bigint"))
    h = F.aggregate(F.when(x.cast("string") != "", codes).otherwise(F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, ch: F.pmod(a * 31 + ch + F.lit(2**31), F.lit(2**32)) - F.lit(2**31))
    return F.when(x.isNotNull(), F.abs(h) % n)


def bucket_fnv(x: Column, n: int) -> Column:
    """Four digits, 0000 to n-1, by the FNV-1a hash of the text's UTF-16 units as the reference computes it (signed xor, product in a double); '__null__' for null."""
    text = x.cast("string")
    units = F.hex(F.encode(text, "UTF-16BE"))
    codes = F.when(text != "", F.transform(F.sequence(F.lit(0), F.greatest(F.length(units) / 4, F.lit(1)).cast("int") - 1), lambda i: F.conv(F.substr(units, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint")))
    signed = lambda h: F.when(h >= 2**31, h - 2**32).otherwise(h)
    step = lambda h, u: F.pmod((signed(h.bitwiseXOR(u)).cast("double") * F.lit(16777619.0)).cast("bigint"), F.lit(2**32))
    h = F.aggregate(F.coalesce(codes, F.array().cast("array<bigint>")), F.lit(2166136261).cast("bigint"), step)
    return F.when(x.isNull(), "__null__").otherwise(F.lpad((h % n).cast("string"), 4, "0"))


def fnv1a(x: Column) -> Column:
    """The public 32-bit FNV-1a hash of a text's UTF-8 bytes; null stays null."""
    digits = F.hex(F.encode(x, "UTF-8"))
    codes = F.when(x != "", F.transform(F.sequence(F.lit(0), F.greatest(F.length(digits) / 2, F.lit(1)).cast("int") - 1), lambda i: F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")))
    h = F.aggregate(F.coalesce(codes, F.array().cast("array<bigint>")), F.lit(2166136261).cast("bigint"), lambda h, b: F.pmod(h.bitwiseXOR(b) * 16777619, F.lit(2**32)))
    return F.when(x.isNotNull(), h)


def truncate(x: Column, width: int, kind: str = "string") -> Column:
    """The first width characters of text, or the multiple of width at or below a number."""
    return F.substring(x, 1, width) if kind == "string" else F.floor(x / width) * width


def identity(x: Column) -> Column:
    return x


def void(x: Column) -> Column:
    return F.lit(None)


def month_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def path(**parts: Column) -> Column:
    """k=v/k=v, null values as the default partition."""
    return F.concat_ws("/", *[F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit(NULL_PARTITION))) for k, v in parts.items()])


def tiered(tiers: list[tuple[DataFrame, str | None]], at: str, key: list[str], since=None, until=None) -> DataFrame:
    """Rows of hot, warm and cold tiers, newest tier first, with at from since to until (either may be None); of rows of one key the newest tier's.

    A tier is (rows, the time before which it holds nothing, or None); tiers that hold nothing of the asked time aren't read. Null keys are rows of their own.
    """
    out = None
    for k, (rows, holds_from) in enumerate(tiers):
        if holds_from is not None and until is not None and str(until) < str(holds_from):
            continue
        part = rows if since is None else rows.where(F.col(at) >= F.lit(since))
        part = (part if until is None else part.where(F.col(at) <= F.lit(until))).withColumn("_tier", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if holds_from is not None and since is not None and str(since) >= str(holds_from):
            break  # this tier holds all of the asked time
    if out is None:
        return tiers[0][0].limit(0).withColumn("_tier", F.lit(0))
    best = out.where(" and ".join(f"`{c}` is not null" for c in key)).groupBy(*key).agg(F.min(F.struct("_tier", F.struct(*[c for c in out.columns if c not in (*key, "_tier")]).alias("r"))).alias("b"))
    best = best.select(*key, F.col("b._tier").alias("_tier"), "b.r.*").select(*out.columns)
    return best.unionByName(out.where(" or ".join(f"`{c}` is null" for c in key)))


def write_partitioned(df: DataFrame, out: str, by: list[str], rows_per_file: int = 5_000_000) -> None:
    """Parquet under out, a folder for each value of by. Rows meet by value and a salt of their own hash, so that a hot value is written by many tasks."""
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(8))
    df.repartition(*[F.col(c) for c in by], salt).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("compression", "snappy").partitionBy(*by).parquet(out)
