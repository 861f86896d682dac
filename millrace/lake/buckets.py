"""Append-only runs of rows in hash buckets by key, sorted within each.

A run is written by one shuffle, as the bucket of a row is the partition that the shuffle sends it to. Rows of equal key lie in the same
bucket of every run and of every store of equal buckets, so merging runs, or joining two stores, needs no shuffle: each task reads one bucket.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import files

BUCKET_BYTES = 64 * 1024 * 1024


def buckets_for(rows: DataFrame) -> int:
    """A number of buckets by the optimizer's size of rows (a guess from above), so that they hold some 64 MB each: as many as there are cores, and no more than the session's shuffles have partitions."""
    spark = rows.sparkSession
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, max(spark.sparkContext.defaultParallelism, math.ceil(size / BUCKET_BYTES))))


@contextmanager
def shuffling_into(spark: SparkSession, partitions: int) -> Iterator[None]:
    """Shuffles that are planned meanwhile have so many partitions."""
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    was = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, str(partitions))
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class BucketedRuns:
    """Runs under a path. What a key and its rows are is fixed by the first run; another session finds it in the folder."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int | None = None, kinds: bool = False):
        """kinds: whether rows have a column mr_kind, each of whose values has files of its own."""
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._parts = ["mr_run", "mr_kind"] if kinds else ["mr_run"]
        self._columns: list[str] | None = None
        self._table = "mr_runs_" + hashlib.md5(self.path.encode()).hexdigest()

    def _open(self, schema: StructType | None = None) -> bool:
        """Make the session know the folder as a bucketed table; False if nothing was ever written there and no schema is given."""
        if self._columns is not None:
            return True
        meta = f"{self.path}/meta/runs.json"
        if schema is not None:
            files.put(self.spark, meta, {"schema": schema.jsonValue(), "key": self.key, "buckets": self.buckets})
        if not files.names(self.spark, f"{self.path}/meta"):
            return False
        m = files.get(self.spark, meta)
        self.key, self.buckets, s = m["key"], m["buckets"], StructType.fromJson(m["schema"])
        s = StructType([f for f in s.fields if f.name not in self._parts])
        ddl = self.spark._jvm.org.apache.spark.sql.types.DataType.fromJson(s.json()).toDDL()
        by = ", ".join(f"`{c}`" for c in self.key)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._table} ({ddl}, {' STRING, '.join(self._parts)} STRING) USING parquet OPTIONS (path '{self.path}/runs') PARTITIONED BY ({', '.join(self._parts)}) CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS")
        self._columns = s.names
        return True

    def write(self, rows: DataFrame, run: str) -> None:
        """Write (or write anew) a run. rows end in an aggregate by key, whose shuffle brings each bucket into one task."""
        if self.buckets is None:
            self.buckets = buckets_for(rows)
        self._open(rows.schema)
        files.remove(self.spark, f"{self.path}/runs/mr_run={run}")
        with shuffling_into(rows.sparkSession, self.buckets):  # a stream's batch has a session of its own
            rows.withColumn("mr_run", F.lit(run)).select(*[F.col(f"`{c}`") for c in [*self._columns, *self._parts]]).write.insertInto(self._table)

    def read(self, runs: list[str]) -> DataFrame | None:
        """Rows of the named runs, a bucket to a task; None if there never was a run."""
        if not self._open():
            return None
        self.spark.catalog.refreshTable(self._table)
        return self.spark.table(self._table).where(F.col("mr_run").isin(*runs)).drop("mr_run")
