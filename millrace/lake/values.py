"""Values that writers of lake metadata spell in several ways, in one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of the kinds of change, after trimming and lower-casing.
INSERT = ("i", "c", "r", "insert", "inserted", "ins", "create", "created", "read", "snapshot")
UPDATE = ("u", "update", "updated", "upd", "upsert", "replace", "merge", "modify")
DELETE = ("d", "delete", "deleted", "del", "remove", "removed", "tombstone")


def operation(op: Column, after: Column | None = None) -> Column:
    """'insert', 'update' or 'delete'. An unknown spelling goes by its first letter; what is still unknown, or null, is an update, or, if after is given and null, a delete."""
    o = F.lower(F.regexp_replace(op, r"(?U)^\s+|\s+$", ""))
    known = F.when(o.isin(*INSERT), "insert").when(o.isin(*UPDATE), "update").when(o.isin(*DELETE), "delete").when(o.startswith("d"), "delete").when(o.startswith("i") | o.startswith("c"), "insert")
    return known.otherwise("update") if after is None else known.when(after.isNull(), "delete").otherwise("update")


def integer(text: Column) -> Column:
    """The integer that text spells, such as ' 4', '4.0', '3,741' or '1_000'; null if it spells none."""
    return F.regexp_replace(F.trim(text), r"[,_'\s]", "").try_cast("decimal(38,0)").try_cast("bigint")


def status(text: Column) -> Column:
    return F.lower(F.trim(text))
