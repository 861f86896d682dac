"""Session, table loading and the shared folder."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "cdc_events", "snapshots", "data_files", "consumer_runs", "rpc_requests", "eval_items", "review_labels",
)


def local_session(cores: int | str = 8, memory: str = "8g", shuffle: int = 8, **conf: str) -> SparkSession:
    """A local session as tests and the bench use it: UTC, AQE, ANSI."""
    b = (
        SparkSession.builder.master(f"local[{cores}]").appName("millrace")
        .config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle)).config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables, by name, from a directory of parquet files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] | list[str]) -> None:
    """Make temp views over the named tables of a directory."""
    for name in names:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It's what the cluster names in spark.checkpoint.dir. Only where that is unset and all runs on one machine (tests) a folder of our own is made
    and set, once for each session. RuntimeError on a cluster that names none: a folder of one machine would be lost with it.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at:
        return at
    now = spark.sparkContext.getCheckpointDir()
    if not now:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        now = spark.sparkContext.getCheckpointDir()
    return now


def shared_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/millrace/{what}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that its lineage ends and no lost executor can take it along."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they run; once for each session."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    here, name, packed = Path(__file__).resolve().parent, f"{shared_path(spark, 'code')}/millrace.zip", io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(Path("millrace") / p.relative_to(here)))
    store(spark, name, [packed.getvalue()])
    sc.addPyFile(name)
    sc._millrace_shipped = True


def store(spark: SparkSession, path: str, chunks) -> None:
    """Bytes as a file, wherever path is."""
    P = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    out = P(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(P(path), True)
    for c in chunks:
        out.write(bytearray(c))
    out.close()
