"""Other feeds as change events: webhooks, traces, analytics events; and the schema of a feed from what it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def webhook_changes(hooks: DataFrame, body: str, provider: str, id_path: str = "$.data.id", type_path: str = "$.type") -> DataFrame:
    """Webhook bodies as changes: an event type that ends in created, deleted or anything else inserts, deletes or updates the object it names."""
    kind = F.lower(F.get_json_object(body, type_path))
    op = F.when(kind.rlike("(created|added|opened)$"), "INSERT").when(kind.rlike("(deleted|removed|closed)$"), "DELETE").otherwise("UPDATE")
    data = F.get_json_object(body, "$.data")
    return hooks.select(
        F.concat_ws(".", F.lit(provider), F.split(kind, r"\.")[0]).alias("table_name"), F.get_json_object(body, id_path).alias("_cdc_row_id"), op.alias("_cdc_operation"),
        F.when(op != "DELETE", data).alias("after_json"), F.when(op == "DELETE", data).alias("before_json"), *hooks.columns,
    )


def trace_changes(traces: DataFrame, trace_id: str, at: str) -> DataFrame:
    """Trace items as inserts into a table of traces, a row each."""
    return traces.select(F.lit("traces").alias("table_name"), F.col(trace_id).cast("string").alias("_cdc_row_id"), F.lit("INSERT").alias("_cdc_operation"), F.to_json(F.struct(*traces.columns)).alias("after_json"), F.col(at).alias("_cdc_timestamp"))


def dated(events: DataFrame, ts: Column) -> DataFrame:
    """events with year, month and day, to be partitioned by."""
    return events.withColumns({"year": F.date_format(ts, "yyyy"), "month": F.date_format(ts, "MM"), "day": F.date_format(ts, "dd")})


def feed_schema(events: DataFrame, payload: str = "after_json") -> DataFrame:
    """field and Spark type over all payloads: the four change columns, then what the payloads carry; kinds that differ, objects and arrays become string.

    Every payload is looked at; fields are aggregated before they are shuffled.
    """
    each = events.select(F.explode(F.from_json(payload, "map<string,string>")).alias("field", "text"), F.col(payload).alias("__doc"))
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("text"), "$", "variant"))
    quoted = F.col("__doc").contains(F.concat(F.lit('"'), F.col("field"), F.lit('":"'))) | F.col("__doc").contains(F.concat(F.lit('"'), F.col("field"), F.lit('": "')))
    t = F.when(F.col("text").isNull(), None).when(quoted, "string").when(kind == "BOOLEAN", "boolean").when(kind == "BIGINT", "bigint").when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "double").otherwise("string")
    kinds = each.select("field", t.alias("type")).groupBy("field").agg(F.sort_array(F.collect_set("type")).alias("k"))
    one = F.when(F.size("k") == 1, F.col("k")[0]).when(F.col("k") == F.array(F.lit("bigint"), F.lit("double")), "double").otherwise("string")
    fixed = events.sparkSession.createDataFrame([("_cdc_sequence", "bigint"), ("_cdc_timestamp", "timestamp"), ("_cdc_operation", "string"), ("_cdc_row_id", "string")], "field string, type string")
    return fixed.unionByName(kinds.select("field", one.alias("type")))
