"""JSON functions with SQLite's behaviour. Reading stays in the JVM; what changes a document, at any path, is an Arrow-batched Python function."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_STEP = re.compile(r"""\.("(?:[^"\\]|\\.)*"|[^.\[\]]+)|\[(\d+|#(?:-\d+)?)\]|\["((?:[^"\\]|\\.)*)"\]""")
_MISSING = object()


def steps(path: str) -> list:
    """The keys and numbers of a path such as $.a[0]["b c"][#]; [#] is the end of an array, [#-1] its last item. Malformed paths raise ValueError."""
    if not path.startswith("$"):
        raise ValueError(f"{path!r} doesn't begin with $")
    out, at = [], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"malformed path {path!r}")
        if m[2] is not None:
            out.append(int(m[2]) if m[2].isdigit() else ("#", int(m[2][1:] or 0)))
        else:
            key = m[1] if m[1] is not None else m[3]
            out.append(key[1:-1] if m[1] is not None and key.startswith('"') else key)
        at = m.end()
    return out


def _index(doc, s):
    return len(doc) + s[1] if isinstance(s, tuple) else s


def _change(doc, path: list, value, create: bool, replace: bool):
    if not path:
        return value if replace else doc
    s = path[0]
    if isinstance(s, str):
        if not isinstance(doc, dict):
            return doc
        there = s in doc
        if len(path) == 1:
            if replace if there else create:
                doc[s] = value
        elif there:
            doc[s] = _change(doc[s], path[1:], value, create, replace)
        elif create:
            doc[s] = _change([] if not isinstance(path[1], str) else {}, path[1:], value, create, replace)
    elif isinstance(doc, list):
        i = _index(doc, s)
        if 0 <= i < len(doc):
            if len(path) > 1:
                doc[i] = _change(doc[i], path[1:], value, create, replace)
            elif replace:
                doc[i] = value
        elif i == len(doc) and create:
            doc.append(value if len(path) == 1 else _change([] if not isinstance(path[1], str) else {}, path[1:], value, create, replace))
    return doc


def _remove(doc, path: list):
    if not path:
        return _MISSING
    s = path[0]
    if isinstance(s, str) and isinstance(doc, dict) and s in doc:
        if len(path) == 1:
            del doc[s]
        else:
            doc[s] = _remove(doc[s], path[1:])
    elif not isinstance(s, str) and isinstance(doc, list) and 0 <= (i := _index(doc, s)) < len(doc):
        if len(path) == 1:
            del doc[i]
        else:
            doc[i] = _remove(doc[i], path[1:])
    return doc


def _merge(doc, patch):
    if not isinstance(patch, dict):
        return patch
    doc = dict(doc) if isinstance(doc, dict) else {}
    for k, v in patch.items():
        if v is None:
            doc.pop(k, None)
        else:
            doc[k] = _merge(doc.get(k), v)
    return doc


def _value(text):
    return json.loads(text) if isinstance(text, str) else None


def _setter(create: bool, replace: bool):
    def make(doc: Column, *pairs) -> Column:
        """doc with values (JSON text columns) at paths: path, value, path, value, ..."""
        paths = [steps(p) for p in pairs[::2]]

        def change(d, *values):
            for p, v in zip(paths, values):
                d = _change(d, p, _value(v), create, replace)
            return d

        return _mapped(change)(doc, F.array(*[v.cast("string") for v in pairs[1::2]]))

    return make


def _mapped(change):
    """A text function of JSON documents and an array of arguments; null and malformed documents give null."""

    @F.pandas_udf(StringType())
    def run(docs: pd.Series, args: pd.Series) -> pd.Series:
        out = []
        for doc, more in zip(docs, args):
            try:
                got = None if not isinstance(doc, str) else change(json.loads(doc), *more)
                out.append(None if got is None or got is _MISSING else json.dumps(got, separators=(",", ":"), ensure_ascii=False))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run


json_set, json_insert, json_replace = _setter(True, True), _setter(True, False), _setter(False, True)


def json_remove(doc: Column, *paths: str) -> Column:
    """doc without what lies at the paths."""
    ps = [steps(p) for p in paths]

    def change(d):
        for p in ps:
            d = _remove(d, p)
            if d is _MISSING:
                return None
        return d

    return _mapped(change)(doc, F.array().cast("array<string>"))


def json_patch(doc: Column, patch: Column) -> Column:
    """RFC 7396: the patch's members replace those of doc, its nulls remove them."""
    return _mapped(lambda d, p: _merge(d, _value(p)))(doc, F.array(patch))


def json_minify(x: Column) -> Column:
    return F.to_json(F.try_parse_json(x))


def json_valid(x: Column) -> Column:
    return F.when(F.try_parse_json(x).isNotNull(), 1).otherwise(0)


def json_extract(x: Column, path: str, kind: str = "string") -> Column:
    """The scalar at a path as kind, or an object or array as text."""
    return F.try_variant_get(F.try_parse_json(x), path, kind)


def json_extract_many(x: Column, *paths: str) -> Column:
    """A JSON array of what lies at each path."""
    v = F.try_parse_json(x)
    return F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(F.to_json(F.try_variant_get(v, p, "variant")), F.lit("null")) for p in paths]), F.lit("]"))


def json_type(x: Column, path: str = "$") -> Column:
    """null, true, false, integer, real, text, array or object; null if there is nothing at the path."""
    v = F.try_variant_get(F.try_parse_json(x), path, "variant")
    s = F.schema_of_variant(v)
    text = F.to_json(v)
    return (
        F.when(s == "VOID", "null").when(s == "BOOLEAN", text).when(s.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer").when(s == "STRING", "text")
        .when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").when(s.startswith("DECIMAL") & ~text.contains("."), "integer").when(s.isNotNull(), "real")
    )


def json_array(*xs: Column) -> Column:
    """An array of values of any kinds; nulls stay."""
    return F.concat(F.lit("["), F.concat_ws(",", *[json_quote(x) for x in xs]), F.lit("]"))


def json_object(*pairs: Column) -> Column:
    """An object of key, value, key, value, ..."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(json_quote(k), F.lit(":"), json_quote(v)) for k, v in zip(pairs[::2], pairs[1::2])]), F.lit("}"))


def json_quote(x: Column) -> Column:
    """A scalar as JSON text."""
    return F.coalesce(F.to_json(F.try_variant_get(F.to_variant_object(F.array(x)), "$[0]", "variant")), F.lit("null"))


def json_array_length(x: Column, path: str = "$") -> Column:
    return F.json_array_length(F.get_json_object(x, path))


def json_each(df: DataFrame, doc: str, path: str = "$") -> DataFrame:
    """Rows of df for each member of the object or array at a path, with key, value (JSON text), type and fullkey. Scalars and malformed documents give none."""
    v = F.try_variant_get(F.try_parse_json(F.col(doc)), path, "variant")
    df = df.withColumn("__v", v).where("schema_of_variant(__v) like 'OBJECT%' or schema_of_variant(__v) like 'ARRAY%'")
    out = df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("__v").outer())).withColumnRenamed("pos", "__pos")
    key = F.coalesce(F.col("key"), F.col("__pos").cast("string"))
    full = F.when(F.col("key").isNull(), F.concat(F.lit(f"{path}["), key, F.lit("]"))).otherwise(F.concat(F.lit(f"{path}."), key))
    text = F.to_json("value")
    return out.select(*[c for c in df.columns if c != "__v"], key.alias("key"), text.alias("value"), json_type(text).alias("type"), full.alias("fullkey"))


def json_tree_udtf():
    """A table function json_tree(doc): every value of a document, with key, value, type, id, parent, fullkey and path."""
    from pyspark.sql.functions import udtf

    class Tree:
        def eval(self, doc: str):
            try:
                root = json.loads(doc) if isinstance(doc, str) else _MISSING
            except ValueError:
                root = _MISSING
            if root is _MISSING:
                return
            todo, n = [(None, root, None, "$", None)], 0
            while todo:
                key, v, parent, full, path = todo.pop()
                kind = {dict: "object", list: "array", str: "text", bool: "true" if v is True else "false", int: "integer", float: "real"}.get(type(v), "null")
                yield key, json.dumps(v, separators=(",", ":"), ensure_ascii=False), kind, n, parent, full, path
                at, n = n, n + 1
                if isinstance(v, dict):
                    todo += [(k, x, at, f"{full}.{k}", full) for k, x in reversed(v.items())]
                elif isinstance(v, list):
                    todo += [(str(i), x, at, f"{full}[{i}]", full) for i, x in reversed(list(enumerate(v)))]

    return udtf(Tree, returnType="key string, value string, type string, id int, parent int, fullkey string, path string")


def json_each_udtf():
    """A table function json_each(doc): the members of an object or array, with key, value, type and fullkey."""
    from pyspark.sql.functions import udtf

    class Each:
        def eval(self, doc: str):
            try:
                root = json.loads(doc) if isinstance(doc, str) else None
            except ValueError:
                root = None
            members = root.items() if isinstance(root, dict) else enumerate(root) if isinstance(root, list) else ()
            for k, v in members:
                kind = {dict: "object", list: "array", str: "text", bool: "true" if v is True else "false", int: "integer", float: "real"}.get(type(v), "null")
                yield str(k), json.dumps(v, separators=(",", ":"), ensure_ascii=False), kind, f"$.{k}" if isinstance(root, dict) else f"$[{k}]"

    return udtf(Each, returnType="key string, value string, type string, fullkey string")
