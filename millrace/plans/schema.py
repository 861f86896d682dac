"""A schema language in Python: tables as dicts of column specifications, to Spark types and to DDL.

A specification is a type name with signs: ! required, # primary key, ? nullable, @ indexed, [] array, = default; or '-> table' and '<- table.column'
for relations.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql.types import StructType

# Base types.
BASE = {
    "string": "string", "text": "string", "uuid": "string", "json": "string", "int": "int", "integer": "int", "long": "bigint", "bigint": "bigint", "float": "float", "double": "double",
    "number": "double", "boolean": "boolean", "bool": "boolean", "date": "date", "datetime": "timestamp", "timestamp": "timestamp", "time": "string", "binary": "binary", "blob": "binary",
}
_SPEC = re.compile(r"^(?P<type>[a-z]+(?:\(\d+(?:,\s*\d+)?\))?)(?P<array>\[\])?(?P<signs>[!#?@]*)(?:\s*=\s*(?P<default>.+))?$", re.I)


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    required: bool = False
    key: bool = False
    indexed: bool = False
    default: str | None = None
    references: str | None = None


def parse_table(columns: dict[str, str]) -> tuple[list[Column], dict[str, str]]:
    """(columns, backward relations by name) of a specification; ValueError if it can't be read."""
    out, back = [], {}
    for name, spec in columns.items():
        s = spec.strip()
        if s.startswith("<-"):
            back[name] = s[2:].strip()
        elif s.startswith("->"):
            out.append(Column(name, "bigint", "!" in s, references=s[2:].strip(" !?")))
        else:
            m = _SPEC.match(s)
            base = m and m["type"].lower()
            if not m or (base not in BASE and not base.startswith("decimal")):
                raise ValueError(f"{name}: {spec!r}")
            kind = base if base.startswith("decimal") else BASE[base]
            out.append(Column(name, f"array<{kind}>" if m["array"] else kind, "!" in m["signs"] or "#" in m["signs"], "#" in m["signs"], "@" in m["signs"], m["default"]))
    return out, back


def struct(spark, columns: dict[str, str]) -> StructType:
    """The Spark schema of a specification."""
    return spark.createDataFrame([], ", ".join(f"`{c.name}` {c.type}" + (" NOT NULL" if c.required else "") for c in parse_table(columns)[0])).schema


def ddl(table: str, columns: dict[str, str]) -> list[str]:
    """CREATE statements of a specification."""
    cols, _ = parse_table(columns)
    kind = lambda t: {"bigint": "INTEGER", "int": "INTEGER", "string": "TEXT", "double": "REAL", "float": "REAL", "binary": "BLOB"}.get(t, "JSON" if t.startswith("array") else t.upper())
    lines = [f"{c.name} {kind(c.type)}" + (" PRIMARY KEY" if c.key else " NOT NULL" if c.required else "") + (f" DEFAULT {c.default}" if c.default else "") + (f" REFERENCES {c.references}(id)" if c.references else "") for c in cols]
    return [f"CREATE TABLE {table} ({', '.join(lines)})", *[f"CREATE INDEX {table}_{c.name} ON {table} ({c.name})" for c in cols if c.indexed]]
