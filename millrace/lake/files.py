"""Small files of lake tables, by Hadoop's file systems: read and written without a Spark job, committed by a rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def fs_of(spark: SparkSession, path: str):
    """(file system, path) as Hadoop has them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def put(spark: SparkSession, path: str, content: dict) -> bool:
    """Write a small file that wasn't there, whole or not at all; False if it is there already."""
    fs, at = fs_of(spark, path)
    fs.mkdirs(at.getParent())
    if fs.exists(at):
        return False
    tmp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at.getParent(), f"_{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if fs.exists(at) or not fs.rename(tmp, at):
        fs.delete(tmp, False)
        return False
    return True


def replace(spark: SparkSession, path: str, content: dict) -> None:
    """Write a small file anew. Between its two renames it is missing for a moment; get() waits for that."""
    fs, at = fs_of(spark, path)
    if not put(spark, path, content):
        fs.delete(at, False)
        if not put(spark, path, content):
            raise OSError(f"somebody else writes {path}")


def get(spark: SparkSession, path: str) -> dict:
    fs, at = fs_of(spark, path)
    stream = fs.open(at)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if there is no folder. Those that begin with _ or . aren't there for readers."""
    fs, at = fs_of(spark, folder)
    return sorted(n for s in fs.listStatus(at) if not (n := s.getPath().getName()).startswith(("_", "."))) if fs.exists(at) else []


def modified(spark: SparkSession, path: str) -> float:
    """Seconds since 1970 of a path's last change."""
    fs, at = fs_of(spark, path)
    return fs.getFileStatus(at).getModificationTime() / 1000


def remove(spark: SparkSession, path: str) -> None:
    fs, at = fs_of(spark, path)
    fs.delete(at, True)
