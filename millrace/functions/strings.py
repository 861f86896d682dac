"""String functions with SQLite's behaviour, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.dialect import glob_regex


def substr(x: Column, start: int, length: int | None = None) -> Column:
    """1-based; 0 means the first character; a start before the beginning (counted from the end) is the first character; a negative length gives ''."""
    n = F.char_length(x)
    at = F.lit(max(start, 1)) if start >= 0 else F.greatest(n + start + 1, F.lit(1))
    return F.when(x.isNull(), None).otherwise(F.substring(x, at, n if length is None else F.lit(max(length, 0))))


def trim(x: Column, chars: str | None = None) -> Column:
    """Without blanks (any white space), or the given characters, at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "") if chars is None else F.btrim(x, F.lit(chars))


def ltrim(x: Column, chars: str | None = None) -> Column:
    return F.regexp_replace(x, r"^\s+", "") if chars is None else F.ltrim(x, F.lit(chars))


def rtrim(x: Column, chars: str | None = None) -> Column:
    return F.regexp_replace(x, r"\s+$", "") if chars is None else F.rtrim(x, F.lit(chars))


def quote(x: Column, kind: str = "string") -> Column:
    """x as an SQL literal: NULL, a number, 'text' or X'hex' of binary."""
    if kind == "binary":
        lit = F.concat(F.lit("X'"), F.hex(x), F.lit("'"))
    elif kind == "string":
        lit = F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
    else:
        lit = x.cast("string")
    return F.coalesce(lit, F.lit("NULL"))


def concat(*xs: Column) -> Column:
    """All arguments in one text; nulls are empty."""
    return F.concat_ws("", *xs)


def char(*points: Column) -> Column:
    """The text of these code points, beyond Latin too."""
    one = lambda p: F.decode(F.unhex(F.lpad(F.hex(p), 8, "0")), "UTF-32")
    return F.concat_ws("", *[one(p) for p in points])


def unicode(x: Column) -> Column:
    """Code point of the first character; null for ''."""
    return F.when(x != "", F.ascii(x))


def unhex(x: Column, default: Column | None = None) -> Column:
    """Bytes of hexadecimal text; null, or default, if it isn't."""
    got = F.when(x.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(x))
    return got if default is None else F.coalesce(got, default)


def zeroblob(n: Column) -> Column:
    """n zero bytes."""
    return F.unhex(F.repeat(F.lit("00"), F.greatest(n, F.lit(0)).cast("int")))


def glob(pattern: str, x: Column) -> Column:
    return x.rlike(glob_regex(pattern))


def printf(template: str, *xs: Column) -> Column:
    """%s %d %f %e %E %g %G %x %X %o %c %% with width and precision; null arguments print NULL (as %s). Halves are rounded up."""
    import re

    parts, args, at, k = [], list(xs), 0, 0
    for m in re.finditer(r"%([-+ #]*)(\d*)(?:\.(\d+))?([sdifeEgGxXoc%])", template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        flags, width, precision, kind = m.groups()
        if kind == "%":
            parts.append(F.lit("%"))
            continue
        x, k = args[k], k + 1
        spec = f"%{flags}{width}" + (f".{precision}" if precision else "")
        if kind in "di":
            one = F.format_string(f"%{flags}{width}d", x.cast("bigint"))
        elif kind in "xXo":
            one = F.format_string(f"%{flags}{width}{kind}", x.cast("bigint"))
        elif kind == "c":
            one = F.format_string(f"%{flags}{width}s", F.substring(x.cast("string"), 1, 1))
        elif kind == "s":
            one = F.format_string(f"{spec}s", x.cast("string"))
        elif kind in "gG":
            one = _general(x.cast("double"), int(precision or 6), kind == "G")
            one = F.lpad(one, int(width), " ") if width and "-" not in flags else F.rpad(one, int(width), " ") if width else one
        else:
            one = F.format_string(f"{spec}{'' if precision else '.6'}{kind}".replace("E", "e"), x.cast("double"))
            one = F.upper(one) if kind == "E" else one
        pad = f"%{flags.replace('+', '').replace('#', '').replace(' ', '')}{width}s"
        parts.append(F.when(x.isNull(), F.format_string(pad, F.lit("NULL"))).otherwise(one))
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts) if parts else F.lit("")


def _general(x: Column, digits: int, upper: bool) -> Column:
    """C's %g: fixed between 1e-4 and 10^digits, else with an exponent; no trailing zeros."""
    e = F.floor(F.log10(F.abs(x))).cast("int")
    e = F.when(F.abs(x) >= F.pow(F.lit(10.0), e + 1) * (1 - 0.5 * 10.0**-digits), e + 1).otherwise(e)
    strip = lambda s: F.when(F.instr(s, ".") > 0, F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    fixed = F.lit(None).cast("string")
    for k in range(-4, digits):
        fixed = F.when(e == k, strip(F.format_string(f"%.{digits - 1 - k}f", x))).otherwise(fixed)
    sci = F.format_string(f"%.{digits - 1}e", x)
    sci = F.concat(strip(F.substring_index(sci, "e", 1)), F.lit("e"), F.substring_index(sci, "e", -1))
    out = F.when(x == 0, "0").otherwise(F.coalesce(fixed, sci))
    return F.upper(out) if upper else out
