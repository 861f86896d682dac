"""Exactly one copy of messages that were delivered at least once.

A message is stored under its identifier: a batch is collapsed in each task, rows go to buckets by the identifier's hash and lie sorted in a
run; compaction merges the runs of a bucket, where rows of equal identifier meet and collapse to the first. Requests have two identifiers,
each with a store of its own, which link them into chains; the chains are resolved by connected components (alternating large and small stars).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, load, shared_path
from . import files
from .buckets import BucketedRuns, buckets_for

HOT = 100_000  # rows of one key that are joined apart
RUNS = 2  # stretches of arrival that a whole feed is upserted in


def _identified(rows: DataFrame, identifier: list[str]) -> DataFrame:
    return rows.where(" and ".join(f"`{c}` is not null" for c in identifier))


def joined_by_node(rows: DataFrame, by: str, lookup: DataFrame, hot: int | None = HOT) -> DataFrame:
    """rows (a, b) with column m of lookup (k, m, n: rows of that node), by rows' column.

    Nodes with more than hot rows (None: there are none) are at most rows/hot many, so they are broadcast, and their rows never gather in one task.
    """
    if hot is None:
        return rows.join(lookup.select("k", "m"), F.col(by) == F.col("k")).select("a", "b", "m")
    few = F.broadcast(lookup.where(F.col("n") > hot).select(F.col("k").alias("__hk"), F.col("m").alias("__hm")))
    own = rows.join(few, F.col(by) == F.col("__hk"), "left")
    done = own.where("__hk is not null").select("a", "b", F.col("__hm").alias("m"))
    rest = own.where("__hk is null").select("a", "b").join(lookup.where(F.col("n") <= hot).select("k", "m"), F.col(by) == F.col("k")).select("a", "b", "m")
    return done.unionByName(rest)


def components(edges: DataFrame, max_rounds: int = 60, hot: int = HOT) -> DataFrame:
    """Connected components of edges (a, b): node, root (the lowest node of its component). Self loops give a component of one.

    Alternates large stars and small stars until nothing changes; rounds grow with the logarithm of the longest chain. Each round is written
    to the shared folder. A node with very many neighbours is only ever aggregated to a minimum before it is shuffled, and its edges stay where they are.
    """
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    now = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = state(now)
    for _ in range(max_rounds):
        most = None if before[0] * 2 <= hot else hot  # with so few edges no node can be hot
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"), "n")
        large = joined_by_node(both, "a", low, most).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("k"), "m", "n")
        near = joined_by_node(large, "a", lower, most)
        now = durable(near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select(F.col("k").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        after = state(now)
        if before == after:
            break
        before = after
    else:
        raise RuntimeError(f"components haven't settled after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


class MessageStore:
    """Hash-bucketed sorted storage of messages, by identifier.

    upsert() appends one sorted run to every bucket and may be repeated with the same batch name; a run counts once its commit file is there.
    read() merges the runs of each bucket, without a shuffle, so that each identifier comes out once, with the row of lowest order.
    compacted() writes that as one run.
    """

    def __init__(self, spark: SparkSession, path: str, identifier: list[str], order: str, buckets: int | None = None):
        self.spark, self.path, self.identifier, self.order = spark, path.rstrip("/"), identifier, order
        self._runs = BucketedRuns(spark, f"{self.path}/store", identifier, buckets)

    def batches(self) -> list[str]:
        return [n.removesuffix(".json") for n in files.names(self.spark, f"{self.path}/commits")]

    def _one(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*self.identifier, self.order)]
        if not rest:
            return rows.groupBy(*self.identifier).agg(F.min(self.order).alias(self.order))
        best = rows.groupBy(*self.identifier).agg(F.min(F.struct(self.order, *rest)).alias("__r"))
        return best.select(*self.identifier, *[F.col(f"__r.{c}").alias(c) for c in (self.order, *rest)])

    def upsert(self, batch_rows: DataFrame, batch: str | None = None) -> None:
        """Add a batch; one that is committed already isn't written again. Rows with a null identifier can't be matched and are refused with ValueError."""
        if batch_rows.where(" or ".join(f"`{c}` is null" for c in self.identifier)).limit(1).count():
            raise ValueError("a row has no identifier")
        self._upsert(batch_rows, batch or uuid.uuid4().hex)

    def _upsert(self, rows: DataFrame, batch: str) -> None:
        if batch in self.batches():
            return
        if self._runs.buckets is None:
            self._runs.buckets = buckets_for(rows)
        self._runs.write(self._one(rows), batch)
        files.put(self.spark, f"{self.path}/commits/{batch}.json", {})

    def read(self) -> DataFrame:
        """One row a message. LookupError if nothing was ever upserted."""
        runs = self.batches()
        if not runs:
            raise LookupError(f"no run at {self.path}")
        rows = self._runs.read(runs)
        return rows if len(runs) == 1 else self._one(rows)

    def compacted(self, path: str) -> "MessageStore":
        t = MessageStore(self.spark, path, self.identifier, self.order, self._runs.buckets)
        t._upsert(self.read(), "merged")
        return t


def stored(rows: DataFrame, identifier: list[str], order: str, runs: int = RUNS, buckets: int | None = None) -> MessageStore:
    """A store of its own, in the shared folder, that rows (identifier and order; null ones left out) were upserted to in so many stretches of order; its runs are merged as it is read."""
    spark, at = rows.sparkSession, shared_path(rows.sparkSession, "messages")
    ok = _identified(rows, identifier).where(F.col(order).isNotNull()).select(*identifier, order)
    lo, hi = ok.agg(F.min(order), F.max(order)).first() if runs > 1 else (None, None)
    store = MessageStore(spark, at, identifier, order, buckets or buckets_for(ok))
    cuts = sorted({lo + (hi - lo) * k // runs for k in range(1, runs)}) if lo is not None else []
    for k, (a, b) in enumerate(zip([None, *cuts], [*cuts, None])):
        part = ok if a is None else ok.where(F.col(order) > a)
        store._upsert(part if b is None else part.where(F.col(order) <= b), f"r{k:04d}")
    return store


def superfluous(rows: DataFrame, identifier: list[str], order: str, runs: int = RUNS) -> DataFrame:
    """identifier and order of all rows of a message but its first, for identifiers that aren't null. Rows of null order tell nothing; repeated rows of equal order count as one.

    What the store keeps is taken away by identifier and order together, so that the copies of a message are spread over all tasks.
    """
    by = [*identifier, order]
    return _identified(rows, by).select(*by).join(stored(rows, identifier, order, runs).read(), by, "left_anti").distinct()


def request_messages(requests: DataFrame, runs: int = RUNS) -> DataFrame:
    """delivery_id and message (the lowest delivery_id of the message it belongs to) of every request.

    Requests are linked if they share session_id and id (neither null), or a key that isn't blank (trimmed, in lower case). Chains of links
    make one message. Of each identifier the store says the first request; only those links go into the components.
    """
    key = F.lower(F.regexp_replace("idempotency_key", r"(?U)^\s+|\s+$", ""))
    rows = requests.select("delivery_id", "session_id", "id", F.when(key != "", key).alias("key")).where("delivery_id is not null")
    first = stored(rows, ["session_id", "id"], "delivery_id", runs).read().withColumnRenamed("delivery_id", "__first")
    # Of a hot identifier only the first of each key goes on, and AQE may split the rest, as compacted rows are shuffled again here.
    own = rows.join(first.hint("shuffle_merge"), ["session_id", "id"], "left").withColumn("by_id", F.coalesce("__first", "delivery_id")).select("delivery_id", "key", "by_id")
    own = durable(own)
    keyed = own.where("key is not null").groupBy("key", "by_id").agg(F.count("*").alias("n"))
    low = stored(keyed, ["key"], "by_id", 1, buckets_for(rows)).read().select(F.col("key").alias("k"), F.col("by_id").alias("b"))
    edges = keyed.join(low, F.col("key") == F.col("k")).select(F.col("by_id").alias("a"), "b").where("a <> b")
    root = components(edges).withColumnRenamed("node", "by_id")
    return own.select("delivery_id", "by_id").join(root, "by_id", "left").select("delivery_id", F.coalesce("root", "by_id").alias("message"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cdc = superfluous(load(spark, sf_dir, "cdc_events"), ["source_do_id", "_cdc_sequence"], "delivery_id")
    rpc = request_messages(load(spark, sf_dir, "rpc_requests")).where("delivery_id > message")
    return cdc.select(F.lit("cdc").alias("feed"), "delivery_id").unionByName(rpc.select(F.lit("rpc").alias("feed"), "delivery_id")).distinct()
