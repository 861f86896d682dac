"""Dates and times with SQLite's behaviour; all in UTC (the session's time zone is taken to be UTC)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_LIMIT = 32_503_680_000  # larger numbers are milliseconds


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _from_micros(us: Column) -> Column:
    return F.timestamp_micros(us.cast("bigint"))


def parse(x: Column) -> Column:
    """A timestamp from text: ISO date or date and time, a time alone (on 2000-01-01), seconds or milliseconds since the epoch, a Julian day with a point. Else null."""
    n = x.try_cast("double")
    julian = x.rlike(r"^\d{5,7}\.\d+$")
    number = F.when(julian, _from_micros(F.round((n - 2440587.5) * 86_400_000.0) * 1000)).when(F.abs(n) < EPOCH_LIMIT, _from_micros(F.round(n * 1e6))).otherwise(_from_micros(n * 1000))
    time = F.when(x.rlike(r"^\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?$"), F.concat(F.lit("2000-01-01 "), x))
    return F.when(n.isNotNull(), number).otherwise(F.coalesce(time.try_cast("timestamp"), x.try_cast("timestamp")))


def add_months_over(ts: Column, months: Column | int) -> Column:
    """Months later on the same day of the month; days beyond the month's end run over into the next (Jan 31 + 1 month is Mar 2 or 3)."""
    t = ts.cast("timestamp")
    first = F.date_trunc("month", t)
    return _from_micros(F.unix_micros(F.add_months(first.cast("date"), months).cast("timestamp")) + (F.unix_micros(t) - F.unix_micros(first)))


def modify(ts: Column, *modifiers: str) -> Column:
    """SQLite modifiers, in order: '+N unit', 'start of day|month|year', 'weekday N' (always forward by a day at least), 'utc', 'localtime'. Others change nothing."""
    t = ts.cast("timestamp")
    for m in (x.strip().lower() for x in modifiers):
        if g := re.fullmatch(r"([+-]?\s*\d+(?:\.\d+)?)\s+(second|minute|hour|day|month|year)s?", m):
            n, unit = float(g[1].replace(" ", "")), g[2]
            if unit in ("month", "year"):
                t = add_months_over(t, int(n) * (12 if unit == "year" else 1))
            else:
                t = _from_micros(F.unix_micros(t) + int(n * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit] * 1_000_000))
        elif g := re.fullmatch(r"start of (day|month|year)", m):
            t = F.date_trunc(g[1], t)
        elif g := re.fullmatch(r"weekday ([0-6])", m):
            ahead = F.pmod(F.lit(int(g[1])) - (F.dayofweek(t) - 1), F.lit(7))
            t = _from_micros(F.unix_micros(t) + F.when(ahead == 0, 7).otherwise(ahead).cast("bigint") * 86_400_000_000)
    return t


def date(ts: Column, *modifiers: str) -> Column:
    return F.date_format(modify(ts, *modifiers), "yyyy-MM-dd")


def time(ts: Column, *modifiers: str) -> Column:
    return F.date_format(modify(ts, *modifiers), "HH:mm:ss")


def datetime(ts: Column, *modifiers: str) -> Column:
    return F.date_format(modify(ts, *modifiers), "yyyy-MM-dd HH:mm:ss")


def julianday(ts: Column, *modifiers: str) -> Column:
    return F.floor(_micros(modify(ts, *modifiers)) / 1000) / 86_400_000.0 + 2440587.5


def unixepoch(ts: Column, *modifiers: str, subsecond: bool = False) -> Column:
    us = _micros(modify(ts, *modifiers))
    return F.floor(us / 1000) / 1000.0 if subsecond else F.floor(us / 1_000_000)


def strftime(fmt: str, ts: Column, *modifiers: str) -> Column:
    """%d %f %H %I %j %J %m %M %s %S %U %w %W %Y %Z %%; each becomes an expression when the query is made."""
    t = modify(ts, *modifiers)
    p2 = lambda c: F.lpad(c.cast("string"), 2, "0")
    wday, yday = F.dayofweek(t) - 1, F.dayofyear(t) - 1
    spec = {
        "d": "dd", "H": "HH", "I": "hh", "j": "DDD", "m": "MM", "M": "mm", "S": "ss", "Y": "yyyy",
    }
    out = []
    for lit, c in re.findall(r"([^%]+)|%(.)", fmt):
        if lit:
            out.append(F.lit(lit))
        elif c in spec:
            out.append(F.date_format(t, spec[c]))
        elif c == "f":
            out.append(F.date_format(t, "ss.SSS"))
        elif c == "J":
            out.append(julianday(t).cast("string"))
        elif c == "s":
            out.append(unixepoch(t).cast("string"))
        elif c == "w":
            out.append(wday.cast("string"))
        elif c == "U":
            out.append(p2(F.floor((yday + 7 - wday) / 7)))
        elif c == "W":
            out.append(p2(F.floor((yday + 7 - F.pmod(wday - 1, F.lit(7))) / 7)))
        elif c == "Z":
            out.append(F.lit("UTC"))
        else:
            out.append(F.lit("%" if c == "%" else f"%{c}"))
    return F.concat(*out) if out else F.lit("")


def timediff(a: Column, b: Column) -> Column:
    """[-]HH:MM:SS.mmm between two moments."""
    ms = F.floor(_micros(a) / 1000) - F.floor(_micros(b) / 1000)
    n = F.abs(ms)
    return F.when(ms.isNotNull(), F.concat(F.when(ms < 0, "-").otherwise(""), F.format_string("%02d:%02d:%02d.%03d", F.floor(n / 3_600_000).cast("bigint"), F.floor(n / 60_000).cast("bigint") % 60, F.floor(n / 1000).cast("bigint") % 60, n.cast("bigint") % 1000)))
