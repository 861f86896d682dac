"""Functions for Database.trigger(): (database, rows) to rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Refused(ValueError):
    """A trigger refused rows."""


def validate(rule: str, message: str) -> Callable:
    """Refuse rows for which a condition isn't true."""

    def f(db, rows: DataFrame) -> DataFrame:
        n = rows.where(f"NOT coalesce({rule}, FALSE)").count()
        if n:
            raise Refused(f"{message}: {n} rows")
        return rows

    return f


def transform(**columns: Column) -> Callable:
    return lambda db, rows: rows.withColumns(columns)


def computed(column: str, expression: str) -> Callable:
    return lambda db, rows: rows.withColumn(column, F.expr(expression))


def timestamps(created: str = "created_at", updated: str = "updated_at") -> Callable:
    """Set updated, and created where it is null."""
    return lambda db, rows: rows.withColumn(updated, F.current_timestamp()).withColumn(created, F.coalesce(F.col(created), F.current_timestamp()))


def audit(table: str, event: str, key: str = "id") -> Callable:
    """Append key, event and the row as JSON to a table (row_id TEXT, event TEXT, row TEXT)."""

    def f(db, rows: DataFrame) -> DataFrame:
        db.append(table, rows.select(F.col(key).cast("string").alias("row_id"), F.lit(event).alias("event"), F.to_json(F.struct(*rows.columns)).alias("row")))
        return rows

    return f


def cascade(child: str, column: str, key: str = "id") -> Callable:
    """After a delete: drop the children of the deleted rows."""

    def f(db, rows: DataFrame) -> DataFrame:
        kids = db.table(child)
        db._drop_rows(child, kids.join(rows.select(F.col(key).alias(column)), column, "left_semi").select(*kids.columns))
        return rows

    return f


def soft_delete(mark: str = "deleted_at", key: str = "id", table: str | None = None) -> Callable:
    """Before a delete: keep the rows (of a keyed table), with the time in a column, and delete nothing."""

    def f(db, rows: DataFrame) -> DataFrame:
        db._apply(table, rows, rows.withColumn(mark, F.current_timestamp()), "soft delete")
        return rows.limit(0)

    return f
