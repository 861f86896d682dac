"""Change logs: subscribing, ordering, deduplicating, batching and applying changes, in batches and as streams."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..lake.upserts import current_rows
from ..lake.values import operation

ENVELOPE = "lsn bigint, ts timestamp, txn string, op string, table_name string, key string, before string, after string"


@dataclass
class Subscription:
    """Which changes somebody wants: after an LSN, of tables, operations, transactions, and a condition in SQL."""

    after_lsn: int = -1
    tables: list[str] = field(default_factory=list)
    ops: list[str] = field(default_factory=list)
    txns: list[str] = field(default_factory=list)
    where: str | None = None

    def apply(self, log: DataFrame) -> DataFrame:
        out = log.where(F.col("lsn") > self.after_lsn)
        for c, vs in (("table_name", self.tables), ("op", self.ops), ("txn", self.txns)):
            if vs:
                out = out.where(F.col(c).isin(*vs))
        return out.where(self.where) if self.where else out


def by_hlc(log: DataFrame, subscription: Subscription | None = None) -> DataFrame:
    """A subscription's changes in the order of their hybrid clock: column hlc, a struct of physicalTime, logicalCounter and nodeId.

    Entries without a clock and control entries are left out. For a stream, call it on each micro-batch in stream_apply(); batches aren't
    reordered among each other.
    """
    data = (subscription or Subscription()).apply(log).where("hlc is not null and op not in ('BEGIN', 'COMMIT', 'ROLLBACK')")
    return data.orderBy("hlc.physicalTime", "hlc.logicalCounter", "hlc.nodeId", "lsn")


def committed(log: DataFrame) -> DataFrame:
    """Changes of transactions that have a COMMIT and no ROLLBACK; changes without a transaction; no control entries."""
    ends = log.where("op in ('COMMIT', 'ROLLBACK')").groupBy("txn").agg(F.max(F.when(F.col("op") == "COMMIT", 1).otherwise(0)).alias("c"), F.max(F.when(F.col("op") == "ROLLBACK", 1).otherwise(0)).alias("r"))
    done = ends.where("c = 1 and r = 0").select("txn")
    data = log.where("op not in ('BEGIN', 'COMMIT', 'ROLLBACK')")
    return data.where("txn is null").unionByName(data.join(done, "txn", "left_semi").select(*data.columns))


def dedup(events: DataFrame, source: str, sequence: str, order: str) -> DataFrame:
    """One row for each (source, sequence): that of lowest order."""
    rest = [c for c in events.columns if c not in (source, sequence)]
    best = events.groupBy(source, sequence).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("r"))
    return best.select(source, sequence, "r.*").select(*events.columns)


def dedup_replicas(events: DataFrame, key: list[str], ts: str, replica: str, window_seconds: int = 60) -> DataFrame:
    """Events without those from replicas that repeat an earlier one of equal key within the window before them."""
    w = W.partitionBy(*key).orderBy(F.unix_micros(F.col(ts).cast("timestamp")), F.col(replica).cast("int")).rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.unix_micros(F.col(ts).cast("timestamp"))).over(w)
    again = F.col(replica) & (F.unix_micros(F.col(ts).cast("timestamp")) - last <= window_seconds * 1_000_000)
    return events.withColumn("__again", F.coalesce(again, F.lit(False))).where("not __again").drop("__again")


def global_lsn(ts: Column, source: Column, lsn: Column) -> Column:
    """An order over all sources: time, then source, then LSN, as a struct."""
    return F.struct(ts.alias("ts"), source.alias("source"), lsn.alias("lsn"))


def tier(rules: list[tuple[str, Column]], default: str = "P2") -> Column:
    """Durability tier by the first rule that holds."""
    out = F.lit(default)
    for t, when in reversed(rules):
        out = F.when(when, t).otherwise(out)
    return out


def partition_key(event_json: Column, ts: Column) -> Column:
    """The event's partition: its own partition_key, or the day of created_at, or of ts."""
    return F.coalesce(F.get_json_object(event_json, "$.partition_key"), F.substring(F.get_json_object(event_json, "$.created_at"), 1, 10), F.date_format(ts, "yyyy-MM-dd"))


def flush_batches(events: DataFrame, source: str, order: str, size: Column, ts: str, max_events: int = 10_000, max_bytes: int = 32 * 1024 * 1024, max_seconds: int = 60) -> DataFrame:
    """events with batch: numbered by source, a new one at each max_events, max_bytes or max_seconds, counted from the source's start.

    A batch ends where any of the three counters passes a multiple, so that it is never larger than any limit (but for a single larger event).
    """
    w = W.partitionBy(source).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    first = F.min(F.unix_micros(F.col(ts).cast("timestamp"))).over(W.partitionBy(source))
    n = F.floor(F.count(F.lit(1)).over(w) / max_events)
    b = F.floor(F.coalesce(F.sum(size).over(w), F.lit(0)) / max_bytes)
    t = F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - first) / (max_seconds * 1_000_000))
    e = events.withColumn("__b", F.struct(n, b, t))
    return e.withColumn("batch", F.dense_rank().over(W.partitionBy(source).orderBy("__b"))).drop("__b")


def latest_state(events: DataFrame, key: list[str], payload: list[str] | None = None) -> DataFrame:
    return current_rows(events, key, payload)


def decode(events: DataFrame, schema: str) -> DataFrame:
    """before and after parsed to structs of a schema; the operation in one spelling."""
    return events.withColumn("operation", operation(F.col("_cdc_operation"), F.col("after_json"))).withColumn("old_data", F.from_json("before_json", schema)).withColumn("data", F.from_json("after_json", schema))


def flatten_payload(events: DataFrame, payload: str, schema: str, prefix: str = "payload") -> DataFrame:
    """Columns prefix_field for the fields of a JSON payload; nested ones prefix_field_field."""
    p = events.withColumn("__p", F.from_json(payload, schema))

    def leaves(t, at):
        for f in t.fields:
            name = [*at, f.name]
            if f.dataType.typeName() == "struct":
                yield from leaves(f.dataType, name)
            else:
                yield name

    cols = [F.col(".".join(["__p", *n])).alias("_".join([prefix, *n])) for n in leaves(p.schema["__p"].dataType, [])]
    return p.select(*[c for c in events.columns if c != payload], *cols)


class Slots:
    """Named durable positions in a log, in a lake table of the catalog."""

    def __init__(self, spark: SparkSession, path: str):
        from ..lake.tables import LakeTable

        self.spark = spark
        try:
            self.table = LakeTable.create(spark, path, "slot string, lsn bigint, filter string")
        except ValueError:
            self.table = LakeTable(spark, path)

    def _all(self) -> dict[str, tuple[int, str]]:
        return {r["slot"]: (r["lsn"], r["filter"]) for r in self.table.read().collect()}  # a few slots

    def _save(self, slots: dict) -> None:
        self.table.overwrite(self.spark.createDataFrame([(k, *v) for k, v in slots.items()], "slot string, lsn bigint, filter string"))

    def create(self, slot: str, lsn: int = -1, **what) -> None:
        s = self._all()
        if slot in s:
            raise ValueError(f"there is a slot {slot}")
        self._save(s | {slot: (lsn, json.dumps(what))})

    def list(self) -> list[str]:
        return sorted(self._all())

    def position(self, slot: str) -> int:
        return self._all()[slot][0]

    def acknowledge(self, slot: str, lsn: int) -> None:
        """Positions never move back."""
        s = self._all()
        self._save(s | {slot: (max(lsn, s[slot][0]), s[slot][1])})

    def drop(self, slot: str) -> None:
        s = self._all()
        del s[slot]
        self._save(s)

    def read(self, slot: str, log: DataFrame) -> DataFrame:
        lsn, what = self._all()[slot]
        return Subscription(lsn, **json.loads(what)).apply(log)


def stream_log(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """New Parquet files of a log's folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def stream_dedup(stream: DataFrame, source: str, sequence: str, ts: str, delay: str = "5 minutes") -> DataFrame:
    """One row for each (source, sequence) within the delay of event time.

    Rows that come later than the delay behind the newest are dropped by the watermark, first deliveries too: choose a delay no delivery exceeds, or
    use stream_once(), which has no such bound.
    """
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([source, sequence])


def stream_apply(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Run write(batch, number) for each micro-batch; its number is the same if a batch is repeated after a failure."""
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def stream_once(stream: DataFrame, store, checkpoint: str):
    """A stream into a lake.dedupe.MessageStore: each message once, however late its copies or its first delivery come. Rows without an identifier are left out."""
    have = " and ".join(f"`{c}` is not null" for c in store.identifier)
    return stream_apply(stream, lambda df, n: store.upsert(df.where(have), f"b{n:010d}"), checkpoint)


def stream_to_table(stream: DataFrame, table, checkpoint: str):
    """A stream into an EqualityDeleteTable; repeated batches overwrite their own files."""
    return stream_apply(stream, lambda df, n: table.append(df, f"b{n:010d}"), checkpoint)
