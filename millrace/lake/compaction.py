"""Consolidating very many small files.

plan_rewrites() finds, in the metadata of lake tables, the files worth rewriting and says which target file each goes to; rewrite()
moves the records there and reports what of the plan it couldn't. compact_directory() range-partitions a directory on the clustering keys
(Spark samples the keys for the boundaries), aims at target_bytes a file, sorts within, and swaps only after counts and checksums agree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import durable
from .files import fs_of as _fs
from .values import integer

SMALL = 8 * 1024 * 1024
TARGET = 128 * 1024 * 1024


def live_files(data_files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Files that were added and never deleted: table_name, file_path, partition_path, size, records.

    Repeated entries count once. An unset size is what the adding snapshot says it added less the sizes of its other files; if that can't
    be known the size stays null. Rows without a table or path aren't files. Null partitions are one partition.
    """
    entries = data_files.where("table_name is not null and file_path is not null")
    added = F.col("status") == 1
    files = entries.groupBy("table_name", "file_path").agg(
        F.max(F.when(added, F.struct("snapshot_id", "partition_path")))["snapshot_id"].alias("snapshot_id"),
        F.max(F.when(added, F.col("partition_path"))).alias("partition_path"),
        F.max(F.when(added, F.col("file_size_in_bytes"))).alias("known"),
        F.max(F.when(added, F.col("record_count"))).alias("records"),
        F.max(F.when(added, 1).otherwise(0)).alias("was_added"),
        F.max(F.when(F.col("status") == 2, 1).otherwise(0)).alias("was_deleted"),
    ).where("was_added = 1")
    files = durable(files)
    # Deleted files count among those their snapshot added, so sizes are filled before they are dropped.
    known = files.groupBy("table_name", "snapshot_id").agg(F.coalesce(F.sum("known"), F.lit(0)).alias("known_sum"), F.count(F.when(F.col("known").isNull(), 1)).alias("unset")).where("unset = 1")
    said = snapshots.groupBy("table_name", "snapshot_id").agg(F.max(integer(F.col("added_files_size"))).alias("said"))
    rest = known.join(said, ["table_name", "snapshot_id"]).select("table_name", "snapshot_id", (F.col("said") - F.col("known_sum")).alias("rest"))
    live = files.where("was_deleted = 0").drop("was_added", "was_deleted")
    return live.join(rest, ["table_name", "snapshot_id"], "left").select("table_name", "file_path", "partition_path", F.coalesce("known", "rest").alias("size"), "records")


def small_files(data_files: DataFrame, snapshots: DataFrame, small: int = SMALL) -> DataFrame:
    """Live files under small bytes that have at least one other such file in their table and partition."""
    files = durable(live_files(data_files, snapshots).where(F.col("size") < small))
    groups = files.groupBy("table_name", "partition_path").agg(F.count("*").alias("n")).where("n > 1").select(F.col("table_name").alias("t"), F.col("partition_path").alias("p"))
    return files.join(groups, (F.col("table_name") == F.col("t")) & F.col("partition_path").eqNullSafe(F.col("p")), "left_semi")


def plan_rewrites(data_files: DataFrame, snapshots: DataFrame, small: int = SMALL, target: int = TARGET, ranges: int | None = None) -> DataFrame:
    """Small files with the target file each goes to.

    Columns: table_name, partition_path, file_path, size, records, target_file. The files are range-partitioned by table, partition and path
    (Spark samples the boundaries); a new target begins at each target bytes of a lake partition. Bytes are summed within a range and carried over
    from range to range, so a hot partition may span many ranges and its targets are the same however many there are. The plan is written to the
    shared folder, as finding and moving the files both go by it. An empty table gives no row.
    """
    files = small_files(data_files, snapshots, small)
    by = ["table_name", "partition_path", "file_path"]
    ranged = files.repartitionByRange(*by) if ranges is None else files.repartitionByRange(ranges, *by)
    ranged = durable(ranged.withColumn("range_no", F.spark_partition_id()))
    within = F.sum("size").over(W.partitionBy("range_no", "table_name", "partition_path").orderBy("file_path").rowsBetween(W.unboundedPreceding, -1))
    sums = ranged.groupBy("table_name", "partition_path", "range_no").agg(F.sum("size").alias("bytes"))
    # One row for each range of a lake partition.
    before = F.sum("bytes").over(W.partitionBy("table_name", "partition_path").orderBy("range_no").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(F.col("table_name").alias("t"), F.col("partition_path").alias("p"), F.col("range_no").alias("r"), F.coalesce(before, F.lit(0)).alias("carried"))
    at = ranged.withColumn("within", F.coalesce(within, F.lit(0))).join(sums, (F.col("table_name") == F.col("t")) & F.col("partition_path").eqNullSafe(F.col("p")) & (F.col("range_no") == F.col("r")))
    no = F.lpad(F.floor((F.col("within") + F.col("carried")) / target).cast("string"), 8, "0")
    return durable(at.select(*by, "size", "records", F.concat(F.lit("lake/"), "table_name", F.lit("/data/"), F.coalesce("partition_path", F.lit("unpartitioned")), F.lit("/compact-"), no, F.lit(".parquet")).alias("target_file")))


@dataclass(frozen=True)
class Rewrite:
    """What a rewrite read and wrote: records, their checksum, files and bytes."""

    rows_before: int
    rows_after: int
    checksum_before: int
    checksum_after: int
    files_before: int
    files_after: int

    @property
    def same(self) -> bool:
        return self.rows_before == self.rows_after and self.checksum_before == self.checksum_after


def row_hash(df: DataFrame, columns: list[str] | None = None):
    """A hash of a row that nulls count in: Spark's hash skips them, so each column says beside its value whether it is null, and nested values are hashed as JSON."""
    nested = lambda t: any(x in t for x in ("map<", "array<", "struct<"))
    cols = [(c, t) for c, t in df.dtypes if columns is None or c in columns]
    value = [F.to_json(F.struct(F.col(f"`{c}`").alias("v")), {"ignoreNullFields": "false"}) if nested(t) else F.col(f"`{c}`") for c, t in cols]
    return F.xxhash64(*value, *[F.col(f"`{c}`").isNull() for c, _ in cols]) if cols else F.lit(0).cast("bigint")


def checksum(df: DataFrame) -> tuple[int, int]:
    """The number of rows and a sum of their hashes that doesn't depend on order; for equal multisets of rows it is equal."""
    r = df.select(row_hash(df).cast("decimal(20,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("s")).first()
    return r["n"], int(r["s"] or 0)


def clustered(df: DataFrame, keys: list[str], files: int) -> DataFrame:
    """df in so many ranges of keys, sorted within. The row's own hash ends the key, so that one key's rows can be split over ranges."""
    spread = F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t])
    return df.withColumn("__spread", spread).repartitionByRange(max(1, files), *[F.col(k) for k in keys], F.col("__spread")).sortWithinPartitions(*keys).drop("__spread")


def directory_files(spark: SparkSession, path: str) -> tuple[int, int]:
    """Files with records under a directory, and their bytes (names that begin with _ or . don't count)."""
    fs, p = _fs(spark, path)
    n = size = 0
    if fs.exists(p):
        it = fs.listFiles(p, True)
        while it.hasNext():
            f = it.next()
            if not f.getPath().getName().startswith(("_", ".")):
                n, size = n + 1, size + f.getLen()
    return n, size


def recover(spark: SparkSession, path: str) -> None:
    """Finish or undo a swap that was cut short: the directory is there afterwards, in its old or its new form, whole."""
    fs, p = _fs(spark, path)
    P = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    old = P(f"{path}.__old")
    if fs.exists(old):
        if fs.exists(p):
            fs.delete(old, True)
        else:
            fs.rename(old, p)
    fs.delete(P(f"{path}.__new"), True)


def compact_directory(spark: SparkSession, path: str, keys: list[str], target: int = TARGET) -> Rewrite:
    """Rewrite a parquet directory into about bytes/target sorted files, and swap it in only if counts and checksums agree.

    A failure at any moment leaves the old or the new directory whole; recover() (called first here) tidies up. An empty directory that
    holds a schema stays. Raises ValueError, with the old directory untouched, if the copy doesn't reconcile.
    """
    recover(spark, path)
    before_files, size = directory_files(spark, path)
    before = spark.read.parquet(path)
    clustered(before, keys, math.ceil(size / target)).write.mode("overwrite").parquet(f"{path}.__new")
    after = spark.read.parquet(f"{path}.__new")
    (n0, c0), (n1, c1) = checksum(before), checksum(after.select(*[F.col(f"`{c}`") for c in before.columns]))
    done = Rewrite(n0, n1, c0, c1, before_files, directory_files(spark, f"{path}.__new")[0])
    if not done.same:
        raise ValueError(f"the copy of {path} doesn't reconcile: {done}")
    fs, p = _fs(spark, path)
    P = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if not fs.rename(p, P(f"{path}.__old")) or not fs.rename(P(f"{path}.__new"), p):
        recover(spark, path)
        raise OSError(f"{path} couldn't be swapped")
    fs.delete(P(f"{path}.__old"), True)
    spark.catalog.refreshByPath(path)
    return done


def current_files(data_files: DataFrame, snapshots: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Where the records of replaced files are now: table_name, file_path, in_file.

    A snapshot of operation replace moves the records of the files it deletes to the one file it adds in the same partition; that may be
    replaced in turn, so each round doubles the steps every file has gone. Where such a snapshot adds several files in a partition, nobody
    can tell which holds what, and the trail ends. RuntimeError if it goes in a circle.
    """
    added, deleted = F.col("status") == 1, F.col("status") == 2
    files = data_files.where("table_name is not null and file_path is not null").groupBy("table_name", "file_path").agg(
        F.max(F.when(added, F.col("snapshot_id"))).alias("added_by"), F.max(F.when(deleted, F.col("snapshot_id"))).alias("deleted_by"), F.max("partition_path").alias("p"))
    replaces = snapshots.where(F.lower(F.trim("operation")) == "replace").select("table_name", F.col("snapshot_id").alias("deleted_by")).distinct()
    gone = files.where("deleted_by is not null").join(replaces, ["table_name", "deleted_by"], "left_semi").alias("g")
    made = files.where("added_by is not null").groupBy("table_name", "added_by", "p").agg(F.min("file_path").alias("in_file"), F.count("*").alias("n")).where("n = 1").alias("m")
    on = (F.col("g.table_name") == F.col("m.table_name")) & (F.col("g.deleted_by") == F.col("m.added_by")) & F.col("g.p").eqNullSafe(F.col("m.p"))
    now = durable(gone.join(made, on).select("g.table_name", "file_path", "in_file").where("file_path <> in_file"))
    for _ in range(max_rounds):
        further = now.select(F.col("table_name").alias("t"), F.col("file_path").alias("f"), F.col("in_file").alias("next"))
        step = durable(now.join(further, (F.col("table_name") == F.col("t")) & (F.col("in_file") == F.col("f")), "left").select("table_name", "file_path", F.coalesce("next", "in_file").alias("in_file"), "next"))
        now = step.drop("next")
        if not step.where("next is not null").limit(1).count():
            return now
    raise RuntimeError("files replace each other in a circle")


def _checksum(df: DataFrame, columns: list[str]):
    return F.sum(row_hash(df.select(*[f"`{c}`" for c in sorted(columns)])).cast("decimal(20,0)"))


def _homes(plan: DataFrame, current: DataFrame | None) -> DataFrame:
    """table_name, file_path, in_file: a plan's files and, by current (of current_files()), the replaced files whose records they hold now."""
    own = plan.select("table_name", "file_path", F.col("file_path").alias("in_file"))
    return own if current is None else own.unionByName(current.join(plan.select("table_name", F.col("file_path").alias("in_file")), ["table_name", "in_file"], "left_semi").select(*own.columns))


def matched(records: DataFrame, plan: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """A plan's files with rows, the records found in each, their checksum, and whole: whether they are as many as the file's metadata says.

    Records name the file they were first written to, by table_name and file_path; current says where those of replaced files are now.
    """
    files = plan.select("table_name", "file_path", "records", "target_file").dropDuplicates(["table_name", "file_path"])
    first = records.groupBy("table_name", "file_path").agg(F.count("*").alias("n"), _checksum(records, records.columns).alias("c"))
    got = first.join(_homes(files, current), ["table_name", "file_path"]).groupBy("table_name", F.col("in_file").alias("file_path")).agg(F.sum("n").alias("rows"), F.sum("c").alias("checksum"))
    return files.join(got, ["table_name", "file_path"], "left").withColumn("rows", F.coalesce("rows", F.lit(0))).withColumn("whole", F.coalesce(F.col("rows") == F.col("records"), F.lit(False)))


def rewrite(records: DataFrame, plan: DataFrame, keys: list[str], out: str, current: DataFrame | None = None) -> DataFrame:
    """Write the records of a plan's files (see matched()) to its target files, sorted by keys, under out; a report by table.

    Columns: table_name, small_files and records as planned, unmoved_files, rows_before (found for the planned files), rows_after (in the
    copy), target_files, reconciled. Only files whose records are all there are moved; the others are listed in out.unmoved and must stay.
    A table is reconciled if no file is unmoved, as many rows were found as planned, and rows and a checksum agree for each target. Each
    target is a folder (mr_target=...) with one file. out.entries are the manifest entries that swap the files: targets added, moved files deleted.
    """
    files = durable(matched(records, plan, current))
    files.where("not whole").select("table_name", "file_path", "records", "rows").write.mode("overwrite").parquet(f"{out}.unmoved")
    whole = files.where("whole").select("table_name", "file_path", F.col("target_file").alias("mr_target"), "rows", "checksum")
    home = _homes(whole, current).join(whole.select("table_name", F.col("file_path").alias("in_file"), "mr_target"), ["table_name", "in_file"]).drop("in_file")
    part = records.join(home, ["table_name", "file_path"]).select(*records.columns, "mr_target")
    part.repartition("mr_target").sortWithinPartitions("mr_target", *keys).write.mode("overwrite").partitionBy("mr_target").parquet(out)
    before = whole.groupBy("table_name", "mr_target").agg(F.sum("rows").alias("n0"), F.sum("checksum").alias("c0")).where("n0 > 0")
    copy = records.sparkSession.read.schema(part.schema).parquet(out)
    after = copy.groupBy("table_name", "mr_target").agg(F.count("*").alias("n1"), _checksum(copy, records.columns).alias("c1"))
    same = F.col("n0").eqNullSafe(F.col("n1")) & F.col("c0").eqNullSafe(F.col("c1"))
    targets = durable(before.join(after, ["table_name", "mr_target"], "full").withColumn("same", same))
    # The swap: manifest entries of a replacing snapshot, of those targets only that hold what their files held.
    ok = targets.where("same")
    new = ok.select("table_name", F.col("mr_target").alias("file_path"), F.lit(1).alias("status"), F.col("n1").alias("record_count"))
    old = whole.join(ok.select("table_name", "mr_target"), ["table_name", "mr_target"], "left_semi").select("table_name", "file_path", F.lit(2).alias("status"), F.col("rows").alias("record_count"))
    new.unionByName(old).write.mode("overwrite").parquet(f"{out}.entries")
    moved = targets.groupBy("table_name").agg(F.sum("n1").alias("rows_after"), F.count("n1").alias("target_files"), F.bool_and("same").alias("same"))
    planned = files.groupBy("table_name").agg(F.count("*").alias("small_files"), F.sum("records").alias("records"), F.count(F.when(~F.col("whole"), 1)).alias("unmoved_files"), F.sum("rows").alias("rows_before"))
    report = planned.join(moved, "table_name", "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("rows_after", "target_files")})
    done = (F.col("unmoved_files") == 0) & (F.col("rows_before") == F.col("records")) & (F.col("rows_after") == F.col("records")) & F.coalesce("same", F.lit(True))
    return report.select("table_name", "small_files", "records", "unmoved_files", "rows_before", "rows_after", "target_files", F.coalesce(done, F.lit(False)).alias("reconciled"))
