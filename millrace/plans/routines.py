"""SQLite's functions in SQL text: calls are rewritten to what Spark has, so that they stay inside Catalyst.

Formats and modifiers of dates and of printf are literals and become expressions when the statement is read. What changes JSON documents is
one Arrow-batched function; json_each and json_tree are table functions.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import jsons
from .lexer import Token, after, closing, lex, solid, split, text


def _instant(x: str) -> str:
    """A timestamp from a value of any kind, as SQL text."""
    if x.strip().lower() in ("'now'", ""):
        return "current_timestamp()"
    n = f"try_cast({x} AS DOUBLE)"
    s = f"cast({x} AS STRING)"
    return (
        f"coalesce(CASE WHEN {s} RLIKE '^[0-9]{{5,7}}[.][0-9]+$' THEN timestamp_micros(cast(round(({n} - 2440587.5) * 86400000D) * 1000 AS BIGINT)) WHEN abs({n}) < 32503680000D THEN timestamp_micros(cast({n} * 1000000D AS BIGINT))"
        f" WHEN {n} IS NOT NULL THEN timestamp_micros(cast({n} * 1000D AS BIGINT)) WHEN {s} RLIKE '^[0-9]{{1,2}}:[0-9]{{2}}' THEN try_cast(concat('2000-01-01 ', {s}) AS TIMESTAMP) END, try_cast({s} AS TIMESTAMP))"
    )


def _modified(args: list[str]) -> str:
    t = _instant(args[0] if args else "'now'")
    for m in (a.strip().strip("'").lower() for a in args[1:]):
        if g := re.fullmatch(r"([+-]?\s*\d+(?:\.\d+)?)\s+(second|minute|hour|day|month|year)s?", m):
            n, unit = float(g[1].replace(" ", "")), g[2]
            if unit in ("month", "year"):
                first = f"date_trunc('month', {t})"
                t = f"timestamp_micros(unix_micros(cast(add_months(cast({first} AS DATE), {int(n) * (12 if unit == 'year' else 1)}) AS TIMESTAMP)) + unix_micros({t}) - unix_micros({first}))"
            else:
                t = f"timestamp_micros(unix_micros({t}) + {int(n * {'second': 1, 'minute': 60, 'hour': 3600, 'day': 86400}[unit] * 1_000_000)}L)"
        elif g := re.fullmatch(r"start of (day|month|year)", m):
            t = f"date_trunc('{g[1]}', {t})"
        elif g := re.fullmatch(r"weekday ([0-6])", m):
            t = f"timestamp_micros(unix_micros({t}) + (pmod({g[1]} - dayofweek({t}), 7) + 1) * 86400000000L)"
    return t


def _strftime(args: list[str]) -> str:
    fmt, t = args[0].strip().strip("'"), _modified(args[1:])
    spec = {"d": "dd", "H": "HH", "I": "hh", "j": "DDD", "m": "MM", "M": "mm", "S": "ss", "Y": "yyyy", "f": "ss.SSS"}
    out = []
    for lit, c in re.findall(r"([^%]+)|%(.)", fmt):
        if lit:
            out.append(f"'{lit}'")
        elif c in spec:
            out.append(f"date_format({t}, '{spec[c]}')")
        else:
            w, y = f"(dayofweek({t}) - 1)", f"(dayofyear({t}) - 1)"
            out.append({
                "J": f"cast(unix_millis({t}) / 86400000D + 2440587.5D AS STRING)", "s": f"cast(unix_seconds({t}) AS STRING)", "w": f"cast({w} AS STRING)", "Z": "'UTC'",
                "U": f"lpad(cast(({y} + 7 - {w}) div 7 AS STRING), 2, '0')", "W": f"lpad(cast(({y} + 7 - pmod({w} - 1, 7)) div 7 AS STRING), 2, '0')", "%": "'%'",
            }.get(c, f"'%{c}'"))
    return f"concat({', '.join(out)})" if out else "''"


def _printf(args: list[str]) -> str:
    fmt, rest, out, at, k = args[0].strip()[1:-1], args[1:], [], 0, 0
    for m in re.finditer(r"%([-+ #]*)(\d*)(?:\.(\d+))?([sdifeExXoc%])", fmt):
        if m.start() > at:
            out.append(f"'{fmt[at : m.start()]}'")
        at = m.end()
        flags, width, precision, kind = m.groups()
        if kind == "%":
            out.append("'%'")
            continue
        x, k = rest[k], k + 1
        cast = "BIGINT" if kind in "dixXo" else "STRING" if kind in "sc" else "DOUBLE"
        x1 = f"cast({x} AS {cast})" if kind != "c" else f"substr(cast({x} AS STRING), 1, 1)"
        spec = f"%{flags}{width}" + (f".{precision}" if precision and kind in "sfeE" else "") + {"i": "d", "c": "s", "E": "e"}.get(kind, kind)
        one = f"format_string('{spec}', {x1})"
        one = f"upper({one})" if kind == "E" else one
        out.append(f"CASE WHEN {x} IS NULL THEN format_string('%{flags.replace('+', '').replace('#', '').replace(' ', '')}{width}s', 'NULL') ELSE {one} END")
    if at < len(fmt):
        out.append(f"'{fmt[at:]}'")
    return f"concat({', '.join(out)})"


def _json(x: str) -> str:
    """Any value as JSON text."""
    if x.strip().upper() == "NULL":
        return "'null'"
    return f"coalesce(to_json(try_variant_get(to_variant_object(array({x})), '$[0]', 'variant')), 'null')"


def _edit(kind: str):
    def f(a: list[str]) -> str:
        if kind == "remove":
            return f"mr_json_edit('remove', cast({a[0]} AS STRING), array({', '.join(a[1:])}), array())"
        if kind == "patch":
            return f"mr_json_edit('patch', cast({a[0]} AS STRING), array('$'), array({a[1]}))"
        return f"mr_json_edit('{kind}', cast({a[0]} AS STRING), array({', '.join(a[1::2])}), array({', '.join(map(_json, a[2::2]))}))"

    return f


def _vec(x: str) -> str:
    return f"transform(CASE WHEN typeof({x}) = 'string' THEN from_json(cast({x} AS STRING), 'array<double>') END, x -> x)" if x.strip().startswith("'") else f"transform({x}, x -> cast(x AS DOUBLE))"


def _dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({_vec(a)}, {_vec(b)}, (x, y) -> x * y), 0D, (s, v) -> s + v)"


def _cos(a: str, b: str) -> str:
    n = f"(sqrt({_dot(a, a)}) * sqrt({_dot(b, b)}))"
    return f"CASE WHEN {n} = 0 THEN 1D ELSE 1D - greatest(-1D, least(1D, try_divide({_dot(a, b)}, {n}))) END"


def _substr(a: list[str]) -> str:
    x, i = a[0], a[1]
    start = f"CASE WHEN {i} > 0 THEN {i} WHEN {i} = 0 THEN 1 ELSE greatest(char_length({x}) + {i} + 1, 1) END"
    return f"substr({x}, {start}" + (f", greatest({a[2]}, 0))" if len(a) > 2 else ")")


ROUTINES = {
    "IIF": lambda a: f"if({a[0]}, {a[1]}, {a[2]})", "SUBSTR": _substr, "SUBSTRING": lambda a: _substr(a) if len(a) > 1 else f"substring({a[0]})",
    "QUOTE": lambda a: f"CASE WHEN {a[0]} IS NULL THEN 'NULL' WHEN typeof({a[0]}) = 'string' THEN concat('\\'', replace(cast({a[0]} AS STRING), '\\'', '\\'\\''), '\\'') ELSE cast({a[0]} AS STRING) END",
    "UNICODE": lambda a: f"CASE WHEN {a[0]} <> '' THEN ascii({a[0]}) END", "ZEROBLOB": lambda a: f"unhex(repeat('00', cast({a[0]} AS INT)))",
    "CHAR": lambda a: "concat(" + ", ".join(f"decode(unhex(lpad(hex(cast({x} AS BIGINT)), 8, '0')), 'UTF-32')" for x in a) + ")",
    "CONCAT": lambda a: f"concat_ws('', {', '.join(a)})", "PRINTF": _printf, "FORMAT": _printf, "MOD": lambda a: f"try_mod({a[0]}, {a[1]})", "TRUNC": lambda a: f"CASE WHEN {a[0]} < 0 THEN ceil({a[0]}) ELSE floor({a[0]}) END" if len(a) == 1 else f"trunc({', '.join(a)})",
    "SQRT": lambda a: f"CASE WHEN {a[0]} >= 0 THEN sqrt({a[0]}) END", "LOG": lambda a: f"CASE WHEN {a[-1]} > 0 THEN " + (f"ln({a[0]})" if len(a) == 1 else f"ln({a[1]}) / ln({a[0]})") + " END",
    "ASIN": lambda a: f"CASE WHEN {a[0]} BETWEEN -1 AND 1 THEN asin({a[0]}) END", "ACOS": lambda a: f"CASE WHEN {a[0]} BETWEEN -1 AND 1 THEN acos({a[0]}) END",
    "MR_RANDOM": lambda a: "cast((rand() - 0.5D) * 18446744073709551616D AS BIGINT)", "RANDOM": lambda a: "cast((rand() - 0.5D) * 18446744073709551616D AS BIGINT)",
    "DATE": lambda a: f"date_format({_modified(a)}, 'yyyy-MM-dd')", "TIME": lambda a: f"date_format({_modified(a)}, 'HH:mm:ss')", "DATETIME": lambda a: f"date_format({_modified(a)}, 'yyyy-MM-dd HH:mm:ss')",
    "JULIANDAY": lambda a: f"(unix_millis({_modified(a)}) / 86400000D + 2440587.5D)", "UNIXEPOCH": lambda a: f"unix_seconds({_modified(a)})", "STRFTIME": _strftime,
    "JSON": lambda a: f"to_json(parse_json({a[0]}))", "JSON_VALID": lambda a: f"if(try_parse_json({a[0]}) IS NOT NULL, 1, 0)", "JSON_QUOTE": lambda a: _json(a[0]),
    "JSON_EXTRACT": lambda a: f"try_variant_get(try_parse_json({a[0]}), {a[1]}, 'string')" if len(a) == 2 else "concat('[', concat_ws(',', " + ", ".join(f"coalesce(to_json(try_variant_get(try_parse_json({a[0]}), {p}, 'variant')), 'null')" for p in a[1:]) + "), ']')",
    "JSON_ARRAY": lambda a: "concat('[', concat_ws(',', " + ", ".join(map(_json, a)) + "), ']')" if a else "'[]'",
    "JSON_OBJECT": lambda a: "concat('{', concat_ws(',', " + ", ".join(f"concat({_json(k)}, ':', {_json(v)})" for k, v in zip(a[::2], a[1::2])) + "), '}')" if a else "'{}'",
    "JSON_ARRAY_LENGTH": lambda a: f"json_array_length(get_json_object({a[0]}, {a[1]}))" if len(a) > 1 else f"json_array_length({a[0]})",
    "JSON_TYPE": lambda a: f"mr_json_type({a[0]}, {a[1] if len(a) > 1 else repr('$')})",
    "JSON_SET": _edit("set"), "JSON_INSERT": _edit("insert"), "JSON_REPLACE": _edit("replace"), "JSON_REMOVE": _edit("remove"), "JSON_PATCH": _edit("patch"),
    "JSON_GROUP_ARRAY": lambda a: f"to_json(transform(sort_array(collect_list(struct({a[0]} AS v))), s -> s.v))",
    "JSON_GROUP_OBJECT": lambda a: f"to_json(map_from_entries(sort_array(collect_set(CASE WHEN {a[0]} IS NOT NULL THEN struct({a[0]} AS k, {a[1]} AS v) END))))",
    "VECTOR": lambda a: f"from_json({a[0]}, 'array<float>')", "VECTOR_EXTRACT": lambda a: f"to_json({a[0]})", "VECTOR_DIMS": lambda a: f"size({a[0]})", "VECTOR_DOT": lambda a: _dot(*a),
    "VECTOR_NORM": lambda a: f"sqrt({_dot(a[0], a[0])})", "VECTOR_DISTANCE_DOT": lambda a: f"(-{_dot(*a)})", "VECTOR_DISTANCE_COS": lambda a: _cos(*a),
    "VECTOR_DISTANCE_L2": lambda a: f"sqrt(aggregate(zip_with({_vec(a[0])}, {_vec(a[1])}, (x, y) -> (x - y) * (x - y)), 0D, (s, v) -> s + v))",
    "VECTOR_NORMALIZE": lambda a: f"transform({_vec(a[0])}, x -> coalesce(try_divide(x, sqrt({_dot(a[0], a[0])})), x))", "VECTOR_ADD": lambda a: f"zip_with({_vec(a[0])}, {_vec(a[1])}, (x, y) -> x + y)",
    "VECTOR_SUB": lambda a: f"zip_with({_vec(a[0])}, {_vec(a[1])}, (x, y) -> x - y)", "VECTOR_SCALE": lambda a: f"transform({_vec(a[0])}, x -> x * {a[1]})",
}


def rewrite_calls(tokens: list[Token]) -> list[Token]:
    """Calls of ROUTINES, innermost first; min and max of several arguments become least and greatest."""
    out, i = [], 0
    while i < len(tokens):
        t, k = tokens[i], after(tokens, i)
        if t.kind == "word" and k < len(tokens) and tokens[k].text == "(" and not (out and out[-1].text == "."):
            end = closing(tokens, k)
            args = [text(rewrite_calls(a)).strip() for a in split(tokens[k + 1 : end])] if solid(tokens[k + 1 : end]) else []
            u = t.text.upper()
            make = ROUTINES.get(u)
            if make is None and u in ("MIN", "MAX") and len(args) > 1:
                make = lambda a, f="least" if u == "MIN" else "greatest": f"{f}({', '.join(a)})"
            if make is not None:
                out.append(Token("raw", make(args)))
                i = end + 1
                continue
        out.append(t)
        i += 1
    return out


def _edit_json(kinds: pd.Series, docs: pd.Series, paths: pd.Series, values: pd.Series) -> pd.Series:
    out = []
    for kind, doc, ps, vs in zip(kinds, docs, paths, values):
        try:
            d = json.loads(doc) if isinstance(doc, str) else None
            if not isinstance(doc, str):
                out.append(None)
                continue
            if kind == "patch":
                d = jsons._merge(d, json.loads(vs[0]))
            else:
                for i, p in enumerate(ps):
                    d = jsons._remove(d, jsons.steps(p)) if kind == "remove" else jsons._change(d, jsons.steps(p), json.loads(vs[i]), kind in ("set", "insert"), kind in ("set", "replace"))
            out.append(None if d is jsons._MISSING else json.dumps(d, separators=(",", ":"), ensure_ascii=False))
        except ValueError:
            out.append(None)
    return pd.Series(out, dtype=object)


def _json_types(docs: pd.Series, paths: pd.Series) -> pd.Series:
    names = {dict: "object", list: "array", str: "text", int: "integer", float: "real", type(None): "null"}
    out = []
    for doc, p in zip(docs, paths):
        try:
            d = json.loads(doc)
            for s in jsons.steps(p):
                d = d[jsons._index(d, s) if not isinstance(s, str) else s]
            out.append(("true" if d else "false") if isinstance(d, bool) else names[type(d)])
        except (ValueError, KeyError, IndexError, TypeError):
            out.append(None)
    return pd.Series(out, dtype=object)


def install(spark: SparkSession) -> None:
    """Register what the rewritten calls need in a session."""
    from ..session import ship

    ship(spark)
    spark.udf.register("mr_json_edit", F.pandas_udf(_edit_json, "string"))
    spark.udf.register("mr_json_type", F.pandas_udf(_json_types, "string"))
    spark.udtf.register("json_tree", jsons.json_tree_udtf())
    spark.udtf.register("json_each", jsons.json_each_udtf())


def routines(sql: str) -> str:
    return text(rewrite_calls(lex(sql)))
