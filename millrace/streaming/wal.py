"""A log of changes that is written here: segments of entries with log sequence numbers, read from any number on, and handed out until acknowledged."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lake import files
from ..lake.tables import Conflict
from ..operators.relational import numbered


class Log:
    """Segments under a path, each named by its first and last number: a reader from a number on opens only what it needs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def segments(self) -> list[tuple[int, int]]:
        """(first, last) number of each segment, in order."""
        return [(int(a), int(b)) for a, b in (n.removesuffix(".json").split("-") for n in files.names(self.spark, f"{self.path}/commits"))]

    def last(self) -> int:
        """The last number written; -1 of an empty log."""
        return max((b for _, b in self.segments()), default=-1)

    def append(self, entries: DataFrame, order: list[Column]) -> tuple[int, int] | None:
        """Write entries as a segment, numbered in an order from the last number on; (first, last), or None if there are none.

        Two writers that take the same numbers: one gets Conflict and writes again. A segment counts once its commit file is there.
        """
        first = self.last() + 1
        rows = numbered(entries, order, "lsn", first)
        n = rows.count()
        if not n:
            return None
        at = f"{self.path}/segments/{first:020d}"
        rows.sortWithinPartitions("lsn").write.mode("overwrite").parquet(at)
        if not files.put(self.spark, f"{self.path}/commits/{first:020d}-{first + n - 1:020d}.json", {"at": at}) or self.segments().count((first, first + n - 1)) > 1 or sum(a == first for a, _ in self.segments()) > 1:
            raise Conflict(f"somebody else wrote from {first} on")
        return first, first + n - 1

    def read(self, after: int = -1, most: int | None = None) -> DataFrame | None:
        """Entries with numbers over after (and at most so many numbers beyond it); None if there are none yet."""
        until = float("inf") if most is None else after + most
        need = [f"{self.path}/segments/{a:020d}" for a, b in self.segments() if b > after and a <= until]
        if not need:
            return None
        rows = self.spark.read.parquet(*need).where(F.col("lsn") > after)
        return rows if most is None else rows.where(F.col("lsn") <= after + most)

    def prune(self, until: int) -> int:
        """Delete segments whose every number is at most until; how many."""
        gone = [(a, b) for a, b in self.segments() if b <= until and b < self.last()]
        for a, b in gone:
            files.remove(self.spark, f"{self.path}/commits/{a:020d}-{b:020d}.json")
            files.remove(self.spark, f"{self.path}/segments/{a:020d}")
        return len(gone)


@dataclass
class Push:
    """Hands a log's entries to a handler in batches, remembering in a slot what was acknowledged.

    handler(batch, first, last) acknowledges by returning; one that raises is given the same batch again, after a pause that doubles, and after
    retries the batch goes to dead letters (a path, or the error is raised). pause() and resume() hold delivery back. Back-pressure: no batch is
    read before the last one is acknowledged.
    """

    log: Log
    slots: object  # streaming.changelog.Slots
    slot: str
    handler: Callable[[DataFrame, int, int], object]
    size: int = 10_000
    retries: int = 3
    wait: float = 0.1
    dead_letters: str | None = None
    paused: bool = False
    delivered: list[tuple[int, int]] = field(default_factory=list)

    def pause(self) -> None:
        self.paused = True

    def resume(self) -> None:
        self.paused = False

    def _batches(self) -> Iterator[tuple[DataFrame, int, int]]:
        while not self.paused:
            at = self.slots.position(self.slot)
            last = min(self.log.last(), at + self.size)
            if last <= at:
                return
            yield self.log.read(at, last - at), at + 1, last

    def run(self) -> int:
        """Deliver what there is; how many batches were acknowledged."""
        n = 0
        for batch, first, last in self._batches():
            for attempt in range(self.retries + 1):
                try:
                    self.handler(batch, first, last)
                    break
                except Exception:
                    if attempt < self.retries:
                        time.sleep(self.wait * 2**attempt)
                    elif self.dead_letters is None:
                        raise
                    else:
                        batch.write.mode("overwrite").parquet(f"{self.dead_letters}/{first:020d}")
            self.slots.acknowledge(self.slot, last)
            self.delivered.append((first, last))
            n += 1
        return n
