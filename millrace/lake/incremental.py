"""Processing each change once: what successful runs have covered is kept as disjoint intervals of sequence numbers.

Intervals are merged, and looked up, within (key, block) groups: an interval is cut at every BLOCK sequence numbers. So a key with very
many intervals is spread over as many groups as its numbers need, and no group is larger than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import load, shared_path
from . import files
from .values import status

BITS = 12
BLOCK = 1 << BITS


def _block(x: Column) -> Column:
    return F.shiftright(x, BITS)


def cut_intervals(intervals: DataFrame, key: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Intervals (lo exclusive, hi inclusive; empty ones vanish) cut at the blocks' edges, with the block they lie in."""
    ok = intervals.where(F.col(lo) < F.col(hi))
    b = F.explode(F.sequence(_block(F.col(lo) + 1), _block(F.col(hi)))).alias("block")
    cut = ok.select(*key, F.col(lo).alias("__lo"), F.col(hi).alias("__hi"), b)
    return cut.select(*key, "block", F.greatest("__lo", F.col("block") * BLOCK - 1).alias("lo"), F.least("__hi", (F.col("block") + 1) * BLOCK - 1).alias("hi"))


def merge_intervals(intervals: DataFrame, key: list[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Disjoint intervals (key, block, lo, hi) with the same union; those that touch become one, within a block."""
    cut = cut_intervals(intervals, key, lo, hi).distinct()
    w = W.partitionBy(*key, "block").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = cut.withColumn("__new", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0))
    no = new.withColumn("__no", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return no.groupBy(*key, "block", "__no").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("__no")


def subtract_intervals(available: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """The gaps: intervals (key, block, lo, hi) of available that done doesn't cover. Both are any (key, lo, hi)."""
    a, d = merge_intervals(available, key), merge_intervals(done, key)
    cutting = a.join(d.select(*key, "block", F.col("lo").alias("d_lo"), F.col("hi").alias("d_hi")), [*key, "block"], "left")
    hit = cutting.where(F.col("d_lo").isNull() | ((F.col("d_lo") < F.col("hi")) & (F.col("d_hi") > F.col("lo"))))
    missed = a.join(hit.select(*key, "block", "lo", "hi").distinct(), [*key, "block", "lo", "hi"], "left_anti").withColumn("cuts", F.array().cast("array<struct<d_lo:bigint,d_hi:bigint>>"))
    # A block's cuts are at most BLOCK/2 disjoint intervals, so the array is bounded.
    grouped = hit.groupBy(*key, "block", "lo", "hi").agg(F.sort_array(F.collect_list(F.when(F.col("d_lo").isNotNull(), F.struct("d_lo", "d_hi")))).alias("cuts"))
    both = grouped.unionByName(missed)
    edges = both.withColumn("from", F.concat(F.array("lo"), F.transform("cuts", lambda c: c["d_hi"]))).withColumn("to", F.concat(F.transform("cuts", lambda c: c["d_lo"]), F.array("hi")))
    gaps = edges.select(*key, "block", F.explode(F.arrays_zip("from", "to")).alias("g"))
    return gaps.select(*key, "block", F.col("g.from").alias("lo"), F.col("g.to").alias("hi")).where("lo < hi")


def covered_by(rows: DataFrame, intervals: DataFrame, key: list[str], at: str) -> DataFrame:
    """Rows whose number lies in one of the merged intervals of its key."""
    iv = intervals.select(*[F.col(c).alias(f"__i_{c}") for c in key], F.col("block").alias("__i_block"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
    on = _block(F.col(at)) == F.col("__i_block")
    for c in key:
        on = on & (F.col(c) == F.col(f"__i_{c}"))
    return rows.join(iv, on & (F.col(at) > F.col("__lo")) & (F.col(at) <= F.col("__hi")), "left_semi")


def successful_runs(runs: DataFrame) -> DataFrame:
    """Runs whose latest entry says succeeded: table_name, run_id, from_snapshot_id, to_snapshot_id. Of entries of one moment the status last in the alphabet decides."""
    last = runs.where("table_name is not null").groupBy("table_name", "run_id").agg(F.max(F.struct("logged_at", status(F.col("status")).alias("status"), "from_snapshot_id", "to_snapshot_id")).alias("e"))
    return last.where("e.status = 'succeeded'").select("table_name", "run_id", "e.from_snapshot_id", "e.to_snapshot_id")


def covered_intervals(runs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Merged intervals of sequence numbers, by table_name, that successful runs have covered.

    A null from_snapshot_id means from the start. A run that names a snapshot that its table doesn't have covers nothing: reading a change
    twice is mended by deduplication, a skipped one is lost.
    """
    order = snapshots.where("sequence_number is not null").groupBy("table_name", "snapshot_id").agg(F.max("sequence_number").alias("no"))
    ok = successful_runs(runs)
    to = order.select("table_name", F.col("snapshot_id").alias("to_snapshot_id"), F.col("no").alias("hi"))
    since = order.select("table_name", F.col("snapshot_id").alias("from_snapshot_id"), F.col("no").alias("known_lo"))
    spans = ok.join(to, ["table_name", "to_snapshot_id"]).join(since, ["table_name", "from_snapshot_id"], "left")
    first = order.groupBy("table_name").agg((F.min("no") - 1).alias("start"))
    lo = F.when(F.col("from_snapshot_id").isNull(), F.col("start")).otherwise(F.col("known_lo"))
    spans = spans.join(first, "table_name").withColumn("lo", lo).where("lo is not null")
    # Of runs that begin, or end, alike only the longest counts, so that runs from the start don't multiply with the history.
    spans = spans.groupBy("table_name", "lo").agg(F.max("hi").alias("hi")).groupBy("table_name", "hi").agg(F.min("lo").alias("lo"))
    return merge_intervals(spans, ["table_name"])


def pending_changes(events: DataFrame, snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Changes none of whose deliveries landed in a covered snapshot: source_do_id, _cdc_sequence.

    Deliveries in snapshots that aren't listed are pending, also of tables without a run. Rows with a null source or sequence identify no
    change and are left out. Repeats are reduced before the shuffles.
    """
    order = snapshots.where("sequence_number is not null").groupBy("table_name", "snapshot_id").agg(F.max("sequence_number").alias("no"))
    done = covered_by(order, covered_intervals(runs, snapshots), ["table_name"], "no").select("table_name", "snapshot_id", F.lit(1).alias("done"))
    ids = events.where("source_do_id is not null and _cdc_sequence is not null").select("source_do_id", "_cdc_sequence", "table_name", "snapshot_id")
    seen = ids.join(done, ["table_name", "snapshot_id"], "left")
    return seen.groupBy("source_do_id", "_cdc_sequence").agg(F.max(F.coalesce("done", F.lit(0))).alias("done")).where("done = 0").drop("done")


class IntervalLedger:
    """What a consumer has processed, as merged intervals, committed together with its output.

    A run writes its output under out/run=<id> and the merged intervals under ledger/run=<id>, and is committed by one small file, made by
    a rename, that names both. Runs without that file don't exist for readers, so a run that dies is simply repeated.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or shared_path(spark, "ledger")).rstrip("/")

    def _commits(self) -> list[dict]:
        return [files.get(self.spark, f"{self.path}/commits/{n}") for n in files.names(self.spark, f"{self.path}/commits")]

    def _last(self) -> list[dict]:
        return [files.get(self.spark, f"{self.path}/commits/{n}") for n in files.names(self.spark, f"{self.path}/commits")[-1:]]

    def done(self, schema: str = "source string, block bigint, lo bigint, hi bigint") -> DataFrame:
        last = self._last()
        return self.spark.read.schema(schema).parquet(last[0]["ledger"]) if last else self.spark.createDataFrame([], schema)

    def pending(self, rows: DataFrame, source: str, sequence: str) -> DataFrame:
        """Rows whose number no committed run holds, late ones in earlier gaps too."""
        ids = rows.select(F.col(source).alias("source"), F.col(sequence).alias("__n")).distinct()
        old = covered_by(ids, self.done(), ["source"], "__n").select(F.col("source").alias("__s"), "__n")
        return rows.join(old, (F.col(source) == F.col("__s")) & (F.col(sequence) == F.col("__n")), "left_anti")

    def commit(self, run_id: str, output: DataFrame, source: str, sequence: str, taken: DataFrame | None = None, fail_before_commit: bool = False) -> bool:
        """Write a run's output and the merged intervals, then make both count. False if that run was committed already.

        taken are the rows the run was given (any with source and sequence): all their numbers count as processed, also those that the run filtered out.
        Without it they are those of the output. Rows of null source or number are no change and aren't noted.
        """
        commits = self._commits()
        if any(c["run"] == run_id for c in commits):
            return False
        no = len(commits)
        output.write.mode("overwrite").parquet(f"{self.path}/out/run={run_id}")
        given = taken if taken is not None else self.spark.read.schema(output.schema).parquet(f"{self.path}/out/run={run_id}")
        new = given.where(F.col(source).isNotNull() & F.col(sequence).isNotNull()).select(F.col(source).alias("source"), (F.col(sequence) - 1).alias("lo"), F.col(sequence).alias("hi")).distinct()
        merged = merge_intervals(self.done().select("source", "lo", "hi").unionByName(new), ["source"])
        merged.write.mode("overwrite").parquet(f"{self.path}/ledger/run={run_id}")
        if fail_before_commit:
            raise RuntimeError("died before the commit")
        if not files.put(self.spark, f"{self.path}/commits/{no:08d}.json", {"no": no, "run": run_id, "ledger": f"{self.path}/ledger/run={run_id}", "out": f"{self.path}/out/run={run_id}"}):
            raise OSError(f"another run took commit {no}")
        return True

    def output(self) -> DataFrame | None:
        """All committed output."""
        outs = [c["out"] for c in self._commits()]
        return self.spark.read.parquet(*outs) if outs else None


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending_changes(load(spark, sf_dir, "cdc_events"), load(spark, sf_dir, "snapshots"), load(spark, sf_dir, "consumer_runs"))


def p4_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a consumer that keeps its ledger has put out after a run that died, its repetition and a run that finds nothing: every pending change once."""
    ledger, todo = IntervalLedger(spark), p4_found(spark, sf_dir)
    for fails in (True, False, False):
        new = ledger.pending(todo, "source_do_id", "_cdc_sequence")
        try:
            ledger.commit("again" if ledger.output() is not None else "first", new, "source_do_id", "_cdc_sequence", new, fail_before_commit=fails)
        except RuntimeError:
            pass
    return ledger.output()


def p4_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By table, how many snapshots and intervals are still to be read."""
    snaps = load(spark, sf_dir, "snapshots").where("sequence_number is not null").select("table_name", (F.col("sequence_number") - 1).alias("lo"), F.col("sequence_number").alias("hi")).distinct()
    gaps = subtract_intervals(snaps, covered_intervals(load(spark, sf_dir, "consumer_runs"), load(spark, sf_dir, "snapshots")), ["table_name"])
    return gaps.groupBy("table_name").agg(F.sum(F.col("hi") - F.col("lo")).alias("snapshots_to_read"))
