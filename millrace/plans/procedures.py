"""Procedures made of parts: checks of arguments, steps around the call, retries, and results in pieces; for Database.procedure()."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from ..lake.tables import Conflict

Step = Callable[[Callable, object, tuple], object]


class InvalidArgument(ValueError):
    """An argument a procedure doesn't take."""


def procedure(body: Callable, *steps: Step) -> Callable:
    """body(database, *arguments) with steps around it, the first outermost. A step is step(call, database, arguments) and calls call(database, *arguments) or not."""
    call = body
    for step in reversed(steps):
        call = lambda db, *args, inner=call, step=step: step(inner, db, args)
    return call


def validated(*rules: Callable[[object], bool] | type | None) -> Step:
    """Each argument by a type or a condition; None lets all pass. Too few or too many arguments are refused, too."""

    def step(call, db, args):
        if len(args) != len(rules):
            raise InvalidArgument(f"{len(args)} arguments for {len(rules)}")
        for i, (rule, a) in enumerate(zip(rules, args)):
            if rule is not None and not (isinstance(a, rule) if isinstance(rule, type) else rule(a)):
                raise InvalidArgument(f"argument {i + 1}: {a!r}")
        return call(db, *args)

    return step


def retrying(times: int = 3, wait: float = 0.05, on: tuple[type[Exception], ...] = (Conflict,)) -> Step:
    """Call again, after a wait that doubles, if somebody else was first."""

    def step(call, db, args):
        for k in range(times):
            try:
                return call(db, *args)
            except on:
                if k == times - 1:
                    raise
                time.sleep(wait * 2**k)

    return step


def in_transaction() -> Step:
    """All the procedure's changes, or none."""

    def step(call, db, args):
        db.sql("BEGIN")
        try:
            out = call(db, *args)
        except BaseException:
            if db._txn:
                db.sql("ROLLBACK")
            raise
        db.sql("COMMIT")
        return out

    return step


def timed(report: Callable[[str, float], None], name: str) -> Step:
    def step(call, db, args):
        t = time.perf_counter()
        try:
            return call(db, *args)
        finally:
            report(name, time.perf_counter() - t)

    return step


def in_pieces(rows: DataFrame, size: int = 10_000) -> Iterator[list]:
    """Rows of a result in lists of at most so many, fetched a partition at a time."""
    piece: list = []
    for r in rows.toLocalIterator(prefetchPartitions=True):
        piece.append(r)
        if len(piece) == size:
            yield piece
            piece = []
    if piece:
        yield piece
