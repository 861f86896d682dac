"""Files as tables: format detection, readers, sinks, and references to them in SQL."""

from __future__ import annotations

import json
import os
import urllib.request
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path, store

SUMS = "_mr_sums.json"

# File name endings and content types of the formats.
ENDINGS = {".json": "json", ".ndjson": "ndjson", ".jsonl": "ndjson", ".csv": "csv", ".tsv": "tsv", ".parquet": "parquet", ".pq": "parquet", ".txt": "text", ".orc": "orc"}
CONTENT_TYPES = {
    "application/json": "json", "text/json": "json", "application/x-ndjson": "ndjson", "application/jsonl": "ndjson", "text/csv": "csv", "text/tab-separated-values": "tsv",
    "application/vnd.apache.parquet": "parquet", "application/parquet": "parquet", "text/plain": "text",
}


@dataclass(frozen=True)
class Detected:
    format: str
    confidence: float
    by: str


def detect_format(name: str, content_type: str | None = None, head: bytes | None = None) -> Detected:
    """The format of a file by its ending, its content type or its first bytes, in this order; text of no confidence if nothing tells."""
    bare = name.split("?")[0].split("#")[0].lower()
    bare = bare.removesuffix(".gz").removesuffix(".zst").removesuffix(".bz2")
    for end, fmt in ENDINGS.items():
        if bare.endswith(end):
            return Detected(fmt, 0.9, "ending")
    if content_type and (fmt := CONTENT_TYPES.get(content_type.split(";")[0].strip().lower())):
        return Detected(fmt, 0.95, "content type")
    if head:
        if head.startswith(b"PAR1"):
            return Detected("parquet", 1.0, "content")
        t = head.lstrip(b"\xef\xbb\xbf \t\r\n")
        if t.startswith(b"["):
            return Detected("json", 0.8, "content")
        if t.startswith(b"{"):
            return Detected("ndjson" if b"}\n{" in t.replace(b"\r", b"") else "json", 0.7, "content")
        lines = [x for x in t.split(b"\n")[:5] if x]
        for sep, fmt in ((b"\t", "tsv"), (b",", "csv")):
            if len(lines) > 1 and lines[0].count(sep) and len({x.count(sep) for x in lines[:-1]}) == 1:
                return Detected(fmt, 0.6, "content")
    return Detected("text", 0.0, "default")


def resolve(uri: str, roots: dict[str, str] | None = None) -> str:
    """A path Spark can read for a URI. roots maps other schemes (say r2://, kv://) to where they live; file:, s3a:, hdfs: and paths stay."""
    scheme = uri.split("://")[0] if "://" in uri else ""
    if roots and scheme in roots:
        return f"{roots[scheme].rstrip('/')}/{uri.split('://', 1)[1]}"
    return f"s3a://{uri[5:]}" if scheme == "s3" else uri


def _fetched(spark: SparkSession, url: str, method: str = "GET", headers: dict | None = None, timeout: float = 30.0, body: bytes | None = None) -> tuple[str, str | None]:
    """A URL's content as a file in the shared folder, and its content type."""
    req = urllib.request.Request(url, data=body, method=method, headers=headers or {})
    out = f"{shared_path(spark, 'fetched')}/{os.path.basename(url.split('?')[0]) or 'fetched.dat'}"
    with urllib.request.urlopen(req, timeout=timeout) as got:
        store(spark, out, iter(lambda: got.read(1 << 22), b""))
        return out, got.headers.get("content-type")


def read_source(spark: SparkSession, path: str, fmt: str | None = None, schema: str | None = None, **options) -> DataFrame:
    """A file, folder or glob as a DataFrame.

    json is one document (an array, or an object) a file; ndjson one a line. csv and tsv: delimiter, quote, header (true) and infer (true).
    Malformed rows give nulls. Types are inferred from all rows unless a schema is given or sampling is set.
    """
    fmt = (fmt or detect_format(path).format).lower()
    r = spark.read.schema(schema) if schema else spark.read
    if fmt in ("json", "ndjson", "jsonl"):
        r = r.option("multiLine", fmt == "json")
        return (r.option("samplingRatio", options["sampling"]) if "sampling" in options else r).json(path)
    if fmt in ("csv", "tsv"):
        true = lambda k, default: str(options.get(k, default)).lower() == "true"
        r = r.option("sep", options.get("delimiter", "\t" if fmt == "tsv" else ",")).option("quote", options.get("quote", '"')).option("escape", options.get("quote", '"'))
        return r.option("header", true("header", True)).option("inferSchema", schema is None and true("infer", True)).option("multiLine", true("multiline", False)).csv(path)
    if fmt == "parquet":
        return r.option("mergeSchema", options.get("merge", "false")).parquet(path)
    if fmt in ("orc", "text"):
        return getattr(r, fmt)(path)
    raise ValueError(f"unknown format {fmt}")


def open_source(spark: SparkSession, uri: str, fmt: str | None = None, **options) -> DataFrame:
    """What url('...', 'FORMAT') and '...' in FROM mean, with the options of WITH (...)."""
    kind = None
    if uri.startswith(("http://", "https://")):
        headers = {k[7:].replace("_", "-"): v for k, v in options.items() if k.startswith("header_")}
        uri, kind = _fetched(spark, uri, options.pop("method", "GET"), headers, float(options.pop("timeout", 30)))
        fmt = fmt or detect_format(uri, kind).format
    return read_source(spark, resolve(uri), fmt, **options)


def stream_source(spark: SparkSession, path: str, fmt: str, schema: str, **options) -> DataFrame:
    """New files of a folder as a stream."""
    r = spark.readStream.schema(schema)
    for k, v in options.items():
        r = r.option(k, v)
    return r.format({"ndjson": "json", "tsv": "csv"}.get(fmt, fmt)).load(path)


def write_sink(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, rows_per_file: int = 0, bloom: list[str] | None = None, compression: str = "snappy", even: bool = False, sums: list[str] | None = None) -> None:
    """A folder of files.

    bloom: columns that get a bloom filter, for point lookups. even: shuffle rows first so that files have about the bytes that adaptive execution
    aims at (spark.sql.adaptive.advisoryPartitionSizeInBytes), which mends both tiny and huge files. rows_per_file caps them, if not 0. sums: numeric
    columns whose sums are noted beside the files, as they are written, for metadata_aggregate().
    """
    seen = Observation(f"sums-{uuid.uuid4().hex}") if sums else None
    if even:
        df = df.hint("rebalance", *partition_by) if partition_by else df.hint("rebalance")
    if seen is not None:
        df = df.observe(seen, *[F.sum(c).cast("string").alias(c) for c in sums])
    w = df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    for c in bloom or []:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    if fmt in ("parquet", "orc"):
        w = w.option("compression", compression)
    if fmt in ("csv", "tsv"):
        w = w.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").option("escape", '"').option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format({"ndjson": "json", "tsv": "csv"}.get(fmt, fmt)).save(path)
    if seen is not None:
        store(df.sparkSession, f"{path}/{SUMS}", [json.dumps(seen.get).encode()])


def metadata_aggregate(spark: SparkSession, path: str, column: str) -> tuple[int, object, object, str | None]:
    """(rows, least, greatest, sum) of a column of Parquet files, from footers alone: Spark's scan answers them from statistics, wherever the files are.

    The sum, as text, is what write_sink(sums=...) noted; None if it noted none. Columns whose files lack statistics (or whose kind has none that can be
    trusted, such as text) are read. An empty folder gives no rows and nulls.
    """
    keys = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}
    was = {k: spark.conf.get(k) for k in keys}
    ask = [F.count("*"), F.min(column), F.max(column)]
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        try:
            n, lo, hi = spark.read.parquet(path).agg(*ask).first()
        except Exception:
            spark.conf.set("spark.sql.parquet.aggregatePushdown", "false")
            n, lo, hi = spark.read.parquet(path).agg(*ask).first()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    from ..lake import files

    fs, at = files.fs_of(spark, f"{path}/{SUMS}")
    return n, lo, hi, files.get(spark, f"{path}/{SUMS}").get(column) if fs.exists(at) else None


def ingest(source: DataFrame, path: str, rows: int = 0, max_bytes: int = 128 * 1024 * 1024) -> int:
    """Write rows in files of about max_bytes (and at most rows, if not 0), by the session's adaptive shuffle; the number of files."""
    spark = source.sparkSession
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    was = spark.conf.get(key)
    spark.conf.set(key, str(max_bytes))
    try:
        write_sink(source, path, rows_per_file=rows, even=True)
    finally:
        spark.conf.set(key, was)
    from ..lake.compaction import directory_files

    return directory_files(spark, path)[0]
