"""Applying inserts, updates and deletes with equality-delete files.

A change is appended as a data row (unless it deletes) and as a delete key. A delete key of an update says "rows of this key before
that sequence are gone"; that of a delete includes its own sequence. Readers anti-join data rows with the delete keys that reach their
sequence, so neither the order nor the number of deliveries matters, and no append rewrites a file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, shared_path
from . import files
from .buckets import BucketedRuns, buckets_for
from .values import operation


def unplaced(events: DataFrame, key: list[str], sequence: str = "_cdc_sequence") -> DataFrame:
    """Changes with a null key or sequence: nobody can tell which row they change or when. Applying leaves them out; here they are."""
    return events.where(" or ".join(f"`{c}` is null" for c in [*key, sequence]))


def folded_changes(events: DataFrame, key: list[str], sequence: str = "_cdc_sequence", op: str = "_cdc_operation", after: str | None = "after_json", payload: list[str] | None = None) -> DataFrame:
    """Of each key: sequence and payload of its data row (null if all its changes delete), and __reach of its delete key.

    Rows with a null key or sequence can't be placed and are left out (see unplaced()). Changes are reduced to one row a key before they are
    shuffled: of data rows the one of highest sequence, of delete keys the furthest reach; so a key with very many changes makes no large group.
    Repeated deliveries fall together; where they differ in payload the greatest is kept. after names the payload that tells, by being null, that
    an unknown operation is a delete; where events have no such column it is an update.
    """
    ok = events.where(" and ".join(f"`{c}` is not null" for c in [*key, sequence]))
    kind = operation(F.col(op), F.col(after) if after in events.columns else None)
    ok = ok.select(*key, F.col(sequence).alias("__seq"), (kind == "delete").alias("__gone"), *(payload or []))
    reach = F.max(F.when(F.col("__gone"), F.col("__seq")).otherwise(F.col("__seq") - 1)).alias("__reach")
    if not payload:
        return ok.groupBy(*key).agg(F.max(F.when(~F.col("__gone"), F.col("__seq"))).alias(sequence), reach)
    rows = ok.groupBy(*key).agg(F.max(F.when(~F.col("__gone"), F.struct("__seq", *payload))).alias("__row"), reach)
    return rows.select(*key, F.col("__row.__seq").alias(sequence), *[F.col(f"__row.{c}").alias(c) for c in payload], "__reach")


def read_current(data: DataFrame, deletes: DataFrame, key: list[str], sequence: str = "_cdc_sequence") -> DataFrame:
    """Data rows no delete key reaches."""
    d = deletes.select(*[F.col(c).alias(f"__d_{c}") for c in key], "__reach")
    on = F.col("__reach") >= F.col(sequence)
    for c in key:
        on = (F.col(c) == F.col(f"__d_{c}")) & on
    return data.join(d, on, "left_anti")


class EqualityDeleteTable:
    """A table in a directory of append-only data and delete files, both in hash buckets by key.

    append() may be called again with the same batch, in any order, or die half way and be repeated: reading gives the same rows. A batch
    counts, data and deletes together, once its commit file is there. Reading joins bucket with bucket, without a shuffle. compacted()
    folds everything into one run and keeps the furthest delete keys, so that late changes are still judged rightly.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], payload: list[str], sequence: str = "_cdc_sequence", buckets: int | None = None):
        self.spark, self.path, self.key, self.payload, self.sequence = spark, path.rstrip("/"), key, payload, sequence
        self._runs = BucketedRuns(spark, f"{self.path}/files", key, buckets, kinds=True)

    def batches(self) -> list[str]:
        """Batches that count."""
        return [n.removesuffix(".json") for n in files.names(self.spark, f"{self.path}/commits")]

    def _store(self, folded: DataFrame, batch: str) -> None:
        """Data files and delete files of a batch, by one shuffle, then its commit file."""
        if self._runs.buckets is None:
            self._runs.buckets = buckets_for(folded)
        kind = F.explode(F.when(F.col(self.sequence).isNull(), F.array(F.lit("delete"))).otherwise(F.array(F.lit("data"), F.lit("delete")))).alias("mr_kind")
        of = lambda c, k: F.when(F.col("mr_kind") == k, F.col(c)).alias(c)
        rows = folded.select("*", kind)
        self._runs.write(rows.select(*self.key, *[of(c, "data") for c in (self.sequence, *self.payload)], of("__reach", "delete"), "mr_kind"), batch)
        files.put(self.spark, f"{self.path}/commits/{batch}.json", {})

    def append(self, events: DataFrame, batch: str | None = None) -> None:
        """Add a batch of changes; one that is committed already isn't written again."""
        batch = batch or uuid.uuid4().hex
        if batch not in self.batches():
            self._store(folded_changes(events, self.key, self.sequence, payload=self.payload), batch)

    def _files(self) -> tuple[DataFrame, DataFrame]:
        """(data rows, delete keys) of all batches that count. LookupError if nothing was ever appended."""
        runs = self.batches()
        if not runs:
            raise LookupError(f"no batch at {self.path}")
        rows = self._runs.read(runs)
        data = rows.where("mr_kind = 'data'").select(*self.key, self.sequence, *self.payload)
        deletes = rows.where("mr_kind = 'delete'").select(*self.key, "__reach")
        return data, deletes if len(runs) == 1 else deletes.groupBy(*self.key).agg(F.max("__reach").alias("__reach"))

    def read(self) -> DataFrame:
        """Key, sequence and payload of the rows there are."""
        now = read_current(*self._files(), self.key, self.sequence)
        if len(self.batches()) == 1:
            return now
        # The delete keys leave one sequence a key; batches may hold the same change, whose greatest payload is kept.
        by = [*self.key, self.sequence]
        return now.groupBy(*by).agg(F.max(F.struct(*self.payload)).alias("r")).select(*by, "r.*") if self.payload else now.distinct()

    def compacted(self, path: str) -> "EqualityDeleteTable":
        """The same table, folded, at another path."""
        t = EqualityDeleteTable(self.spark, path, self.key, self.payload, self.sequence, self._runs.buckets)
        deletes = self._files()[1]
        both = deletes.join(self.read(), self.key, "left").select(*self.key, self.sequence, *self.payload, "__reach")
        t._store(both, "compact")
        return t


def applied(events: DataFrame, key: list[str], payload: list[str] | None = None) -> EqualityDeleteTable:
    """A table of its own, in the shared folder, that the events were appended to."""
    t = EqualityDeleteTable(events.sparkSession, shared_path(events.sparkSession, "applied"), key, payload or [])
    t.append(events, "feed")
    return t


def current_rows(events: DataFrame, key: list[str], payload: list[str] | None = None) -> DataFrame:
    """The rows that exist after all changes: key, _cdc_sequence of the last change, payload columns. An empty feed gives no row."""
    return applied(events, key, payload).read()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_rows(load(spark, sf_dir, "cdc_events"), ["table_name", "_cdc_row_id"])


def p2_current_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current rows with a stable digest of their payload (repeated deliveries may be serialised differently, so keys, not text, count)."""
    rows = current_rows(load(spark, sf_dir, "cdc_events"), ["table_name", "_cdc_row_id"], ["after_json"])
    return rows.select("table_name", "_cdc_row_id", "_cdc_sequence", F.size(F.json_object_keys("after_json")).alias("n_fields"))


def p2_unplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By table, all deliveries and those that applying had to leave out."""
    e = load(spark, sf_dir, "cdc_events")
    lost = unplaced(e, ["table_name", "_cdc_row_id"]).groupBy(F.col("table_name").alias("t")).agg(F.count("*").alias("n"))
    every = e.groupBy("table_name").agg(F.count("*").alias("deliveries"))
    return every.join(lost, F.col("table_name").eqNullSafe(F.col("t")), "left").select("table_name", "deliveries", F.coalesce("n", F.lit(0)).alias("unplaced"))
