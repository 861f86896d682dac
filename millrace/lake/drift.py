"""Schemas that drift: what fields each snapshot carries, every change between snapshots, and one table from all versions.

Payloads are profiled in one pass that emits one row a snapshot and task; from there only lifetimes of fields are aggregated, so no table,
however many snapshots it has, is gathered in one place. Where a table loses and gains fields at one snapshot, the lost and gained ones are
profiled by value sketch, kind and name, matched as a bipartite graph, and the matches are held against every delivery that shows both. Where
no delivery does, likely_renames() guesses.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import durable, load

KINDS = ("string", "number", "boolean", "object", "array")
SKETCH = 32  # lowest value hashes kept of a field
BLOCK_BITS = 10  # 1024 numbers of a table are ordered together
BROADCAST_ROWS = 100_000  # fields that came or went that may be broadcast: some 10 MB
FLUSH = 200_000  # fields a task holds before it sends them on


def _kind(v) -> int:
    """The bit of a JSON value's kind; 0 of null."""
    if v is None:
        return 0
    if isinstance(v, str):
        return 1
    if isinstance(v, bool):
        return 4
    if isinstance(v, (int, float)):
        return 2
    return 8 if isinstance(v, dict) else 16


def _object(text: str | None) -> dict:
    """The object that text spells; empty if it spells none."""
    if not text:
        return {}
    try:
        v = json.loads(text)
    except (ValueError, RecursionError):
        return {}
    return v if isinstance(v, dict) else {}


def _list(kind: pa.DataType) -> pa.DataType:
    """A list as Spark names its parts, so that batches needn't be cast."""
    return pa.list_(pa.field("element", kind))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple, dict[str, int]] = {}
    size = 0

    def out() -> pa.RecordBatch:
        keys = list(seen)
        names, kinds = pa.array([list(seen[x]) for x in keys], _list(pa.string())), pa.array([list(seen[x].values()) for x in keys], _list(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.int64()), names, kinds], names=["table_name", "snapshot_id", "names", "kinds"])

    for b in batches:
        for t, s, after in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            at = seen.get((t, s))
            if at is None:
                at = seen[(t, s)] = {}
                size += 1
            for f, v in _object(after).items():
                k = at.get(f)
                if k is None:
                    k = 0
                    size += 1
                at[f] = k | _kind(v)
        if size > FLUSH:
            yield out()
            seen.clear()
            size = 0
    if seen:
        yield out()


def snapshot_order(snapshots: DataFrame) -> DataFrame:
    """table_name, snapshot_id, no; repeated rows once, rows without a number not at all."""
    return snapshots.where("sequence_number is not null and table_name is not null").groupBy("table_name", "snapshot_id").agg(F.max("sequence_number").alias("no"))


def carried_fields(events: DataFrame, order: DataFrame) -> DataFrame:
    """table_name, no, snapshot_id, fields (field, kinds as bits) of snapshots that landed a payload; one row a task and snapshot.

    Events without a payload or whose snapshot isn't listed don't count. A payload that isn't an object carries no field.
    """
    shown = events.where("after_json is not null and table_name is not null").select("table_name", "snapshot_id", "after_json")
    rows = shown.mapInArrow(_profile, "table_name string, snapshot_id bigint, names array<string>, kinds array<int>")
    return rows.join(order, ["table_name", "snapshot_id"]).withColumn("fields", F.arrays_zip("names", "kinds")).drop("names", "kinds")


def following(steps: DataFrame) -> DataFrame:
    """Of distinct (table_name, no): the next no of the table, without ordering a whole table in one task.

    Numbers are ordered within blocks; the last of a block is followed by the first of the next block there is.
    """
    b = steps.withColumn("block", F.shiftright("no", BLOCK_BITS))
    inner = b.withColumn("next", F.lead("no").over(W.partitionBy("table_name", "block").orderBy("no")))
    firsts = b.groupBy("table_name", "block").agg(F.min("no").alias("first"))
    outer = firsts.withColumn("next_block", F.lead("first").over(W.partitionBy("table_name").orderBy("block"))).drop("first")
    return inner.join(outer, ["table_name", "block"]).select("table_name", "no", F.coalesce("next", "next_block").alias("next"))


def lifetimes(carried: DataFrame) -> DataFrame:
    """Of each table and field: first and last number that carried it, and of each kind the first and last number with such a value."""
    each = carried.select("table_name", "no", F.explode("fields").alias("f")).select("table_name", "no", F.col("f.names").alias("field"), F.col("f.kinds").alias("kinds"))
    has = lambda i: F.when(F.col("kinds").bitwiseAND(1 << i) != 0, F.col("no"))
    kinds = [x for i, k in enumerate(KINDS) for x in (F.min(has(i)).alias(f"min_{k}"), F.max(has(i)).alias(f"max_{k}"))]
    return each.groupBy("table_name", "field").agg(F.min("no").alias("first"), F.max("no").alias("last"), *kinds)


def _retyped_at():
    """The number from which a field's values are of another kind, if they were of one kind before; else null."""
    present = sum((F.when(F.col(f"min_{k}").isNotNull(), 1).otherwise(0) for k in KINDS), F.lit(0))
    at = F.lit(None).cast("bigint")
    for a in KINDS:
        for b in KINDS:
            if a != b:
                at = F.when(F.col(f"max_{a}") < F.col(f"min_{b}"), F.col(f"min_{b}")).otherwise(at)
    return F.when(present == 2, at)


def _sketch(values: set[int]) -> list[int]:
    return sorted(values)[:SKETCH]


def _text(v) -> str:
    """Equal values have equal text: numbers by value, objects by content."""
    if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
        v = int(v)
    return json.dumps(v, sort_keys=True)


def _same(a, b) -> bool:
    return a == b and _text(a) == _text(b) if isinstance(a, (dict, list)) or isinstance(a, bool) or isinstance(b, bool) else a == b


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=7).digest(), "big")


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each candidate: deliveries that show both fields, how many are equal, how many not null, sketches and kinds (as bits) of either side."""
    n: dict[tuple, list] = defaultdict(lambda: [0, 0, 0, 0, 0, set(), set()])
    last, was, now = None, {}, {}
    for b in batches:
        for t, at, old, new, before, after in zip(*(b.column(i).to_pylist() for i in range(6))):
            if (before, after) != last:
                last, was, now = (before, after), _object(before), _object(after)
            if old not in was or new not in now:
                continue
            x, y = was[old], now[new]
            e = n[t, at, old, new]
            e[0] += 1
            e[1] += _same(x, y)
            e[2] += x is not None
            e[3] |= _kind(x)
            e[4] |= _kind(y)
            for v, k in ((x, 5), (y, 6)):
                if v is not None:
                    e[k].add(_hash(_text(v)))
                    if len(e[k]) > 8 * SKETCH:
                        e[k] = set(_sketch(e[k]))
    if n:
        cols = list(zip(*((*k, *e[:5], _sketch(e[5]), _sketch(e[6])) for k, e in n.items())))
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5, _list(pa.int64()), _list(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, types)], names=["table_name", "at", "old_field", "new_field", "n", "n_equal", "n_value", "old_kinds", "new_kinds", "old_values", "new_values"])


def assignment(weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a bipartite matching of greatest total weight; pairs of weight 0 or less aren't matched.

    Shortest augmenting paths over potentials, cubic in the number of fields that change at one snapshot.
    """
    rows, cols = weight.shape
    size = max(rows, cols)
    cost = np.zeros((size + 1, size + 1))
    cost[1 : rows + 1, 1 : cols + 1] = -np.maximum(weight, 0)
    u, v, match = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1, int)
    for i in range(1, size + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(size + 1, np.inf), np.zeros(size + 1, int), np.zeros(size + 1, bool)
        while match[j0]:
            used[j0] = True
            i0, free = match[j0], ~used
            free[0] = False
            reduced = cost[i0] - u[i0] - v
            better = free & (reduced < least)
            least[better], way[better] = reduced[better], j0
            j1 = int(np.argmin(np.where(free, least, np.inf)))
            step = least[j1]
            u[match[used]] += step
            v[used] -= step
            least[free] -= step
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, size + 1) if match[j] <= rows and j <= cols and weight[match[j] - 1, j - 1] > 0]


def _likeness(names: tuple[str, str], values: float, kinds: bool) -> float:
    """How much alike two fields are: share of equal values, likeness of names, sameness of kinds."""
    return values + 0.5 * SequenceMatcher(None, names[0].lower(), names[1].lower()).ratio() + 0.5 * kinds


def _pairing(pdf: pd.DataFrame, weight) -> list[tuple]:
    """Rows of one table and snapshot that a bipartite matching of greatest weight picks, with their weight."""
    olds, news = {x: i for i, x in enumerate(sorted(set(pdf.old_field)))}, {x: i for i, x in enumerate(sorted(set(pdf.new_field)))}
    w, row = np.zeros((len(olds), len(news))), {}
    for r in pdf.itertuples():
        at = olds[r.old_field], news[r.new_field]
        w[at], row[at] = weight(r), r
    return [(row[at], float(w[at])) for at in assignment(w)]


def _match(pdf: pd.DataFrame) -> pd.DataFrame:
    """Renames among the pairs of one table and snapshot. Weights: likeness and the number of deliveries; 0 unless every delivery agrees."""

    def weight(r) -> float:
        if r.n != r.n_equal or not r.n_value:
            return 0
        a, b = set(r.old_values), set(r.new_values)
        low = sorted(a | b)[:SKETCH]
        return 1 + _likeness((r.old_field, r.new_field), sum(x in a and x in b for x in low) / max(1, len(low)), r.old_kinds == r.new_kinds) + r.n_value / (1 + r.n_value)

    rows = [(r.table_name, int(r.at), r.old_field, r.new_field) for r, _ in _pairing(pdf, weight)]
    return pd.DataFrame(rows, columns=["table_name", "at", "old_field", "new_field"], dtype=object)


def _bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df (written already), to be broadcast if it has no more than so many rows; beyond that joins shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


@dataclass
class Lifetimes:
    """What schema_changes() and likely_renames() both start from: order of snapshots, fields' lives, fields that came and went, and when."""

    order: DataFrame
    life: DataFrame
    added: DataFrame
    removed: DataFrame


def field_lifetimes(events: DataFrame, snapshots: DataFrame) -> Lifetimes:
    order = snapshot_order(snapshots)
    carried = durable(carried_fields(events, order).select("table_name", "no", "fields"))
    steps = carried.select("table_name", "no").distinct()
    life = durable(lifetimes(carried))
    start = steps.groupBy("table_name").agg(F.min("no").alias("start"))
    ends = life.select("table_name", "field", F.col("last").alias("no")).join(following(steps), ["table_name", "no"]).where("next is not null")
    added = life.join(start, "table_name").where("first > start").select("table_name", F.col("first").alias("at"), F.col("field").alias("new_field"))
    removed = ends.select("table_name", F.col("next").alias("at"), F.col("field").alias("old_field"))
    return Lifetimes(order, life, durable(added), durable(removed))


def rename_evidence(events: DataFrame, fields: Lifetimes) -> DataFrame:
    """Of each field lost and field gained at one snapshot that some delivery from there on shows before and after: what those deliveries say.

    Deliveries meet the lost fields by table and name, then the gained ones by table and snapshot, so none carries a table's history with it.
    """
    both = events.where("before_json is not null and after_json is not null and table_name is not null").select("table_name", "snapshot_id", "before_json", "after_json")
    meant = fields.removed.join(fields.added.select("table_name", "at").distinct(), ["table_name", "at"], "left_semi")
    named = both.withColumn("old_field", F.explode(F.json_object_keys("before_json"))).join(_bounded(meant), ["table_name", "old_field"])
    pairs = named.join(_bounded(fields.added), ["table_name", "at"]).where(F.array_contains(F.json_object_keys("after_json"), F.col("new_field")))
    shown = pairs.join(fields.order, ["table_name", "snapshot_id"]).where("no >= at").select("table_name", "at", "old_field", "new_field", "before_json", "after_json")
    parts = shown.mapInArrow(_evidence, "table_name string, at bigint, old_field string, new_field string, n bigint, n_equal bigint, n_value bigint, old_kinds bigint, new_kinds bigint, old_values array<bigint>, new_values array<bigint>")
    low = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, SKETCH).alias(c)
    return parts.groupBy("table_name", "at", "old_field", "new_field").agg(*[F.sum(c).alias(c) for c in ("n", "n_equal", "n_value")], *[F.bit_or(c).alias(c) for c in ("old_kinds", "new_kinds")], low("old_values"), low("new_values"))


def schema_changes(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every change of shape: table_name, snapshot_id, change_kind (added, removed, renamed, retyped), old_field, new_field.

    Changes are judged by what payloads carry, whatever schema ids say. A field that vanishes for a while and returns is neither removed nor added
    then. Empty tables give no row.
    """
    fields = field_lifetimes(events, snapshots)
    order, life, added, removed = fields.order, fields.life, fields.added, fields.removed
    retyped = life.withColumn("at", _retyped_at()).where("at is not null").select("table_name", "at", F.col("field").alias("old_field"), F.col("field").alias("new_field"), F.lit("retyped").alias("change_kind"))
    # The groups are small and many: as many tasks as there are cores share them.
    evidence = rename_evidence(events, fields).repartition(events.sparkSession.sparkContext.defaultParallelism, "table_name", "at")
    renamed = durable(evidence.groupBy("table_name", "at").applyInPandas(_match, "table_name string, at bigint, old_field string, new_field string"))
    gone = removed.join(renamed, ["table_name", "at", "old_field"], "left_anti").select("table_name", "at", "old_field", F.lit("").alias("new_field"), F.lit("removed").alias("change_kind"))
    came = added.join(renamed, ["table_name", "at", "new_field"], "left_anti").select("table_name", "at", F.lit("").alias("old_field"), "new_field", F.lit("added").alias("change_kind"))
    cases = gone.unionByName(came).unionByName(renamed.withColumn("change_kind", F.lit("renamed"))).unionByName(retyped)
    ids = order.groupBy("table_name", "no").agg(F.min("snapshot_id").alias("snapshot_id"))
    return cases.join(ids.withColumnRenamed("no", "at"), ["table_name", "at"]).select("table_name", "snapshot_id", "change_kind", "old_field", "new_field")


def likely_renames(events: DataFrame, snapshots: DataFrame, least: float = 1.0) -> DataFrame:
    """Renames that no delivery proves, as none shows the field before and after: table_name, snapshot_id, old_field, new_field, score.

    Fields lost and gained at one snapshot are profiled by theta sketches of all their values and by kinds, and matched as a bipartite graph;
    pairs are told from a score of least on (share of common values, plus half each for names and kinds). They are guesses, so
    schema_changes() doesn't use them. Empty tables give no row.
    """
    fields = field_lifetimes(events, snapshots)
    proven = rename_evidence(events, fields).select("table_name", "at", "old_field", "new_field")
    open_ = durable(fields.removed.join(fields.added, ["table_name", "at"]).join(proven, ["table_name", "at", "old_field", "new_field"], "left_anti"))
    names = durable(open_.select("table_name", F.col("old_field").alias("field")).unionByName(open_.select("table_name", F.col("new_field").alias("field"))).distinct())
    values = events.where("after_json is not null").select("table_name", F.explode(F.from_json("after_json", "map<string,string>")).alias("field", "value")).join(_bounded(names), ["table_name", "field"])
    sketch = durable(values.where("value is not null").groupBy("table_name", "field").agg(F.theta_sketch_agg("value").alias("sketch")))
    kinds = fields.life.select("table_name", "field", F.concat_ws(",", *[F.when(F.col(f"min_{k}").isNotNull(), F.lit(k)) for k in KINDS]).alias("kinds"))
    side = lambda c: sketch.join(kinds, ["table_name", "field"]).select("table_name", F.col("field").alias(f"{c}_field"), F.col("sketch").alias(f"{c}_sketch"), F.col("kinds").alias(f"{c}_kinds"))
    size = lambda f: F.theta_sketch_estimate(f("old_sketch", "new_sketch"))
    share = (size(F.theta_intersection) / size(F.theta_union)).alias("share")
    pairs = open_.join(side("old"), ["table_name", "old_field"]).join(side("new"), ["table_name", "new_field"]).select("table_name", "at", "old_field", "new_field", share, (F.col("old_kinds") == F.col("new_kinds")).alias("alike"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        got = _pairing(pdf, lambda r: w if (w := _likeness((r.old_field, r.new_field), r.share, r.alike)) >= least else 0)
        return pd.DataFrame([(r.table_name, int(r.at), r.old_field, r.new_field, w) for r, w in got], columns=["table_name", "at", "old_field", "new_field", "score"])

    found = pairs.groupBy("table_name", "at").applyInPandas(best, "table_name string, at bigint, old_field string, new_field string, score double")
    ids = fields.order.groupBy("table_name", "no").agg(F.min("snapshot_id").alias("snapshot_id")).withColumnRenamed("no", "at")
    return found.join(ids, ["table_name", "at"]).select("table_name", "snapshot_id", "old_field", "new_field", "score")


def _latest_names(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where each old name of a table ends, along chains of renames."""
    step = dict(zip(pdf.old_field, pdf.new_field))
    out = []
    for name in step:
        at, seen = name, {name}
        while at in step and step[at] not in seen:
            at = step[at]
            seen.add(at)
        out.append((pdf.table_name.iloc[0], name, at))
    return pd.DataFrame(out, columns=["table_name", "old_field", "field"], dtype=object)


def unify(events: DataFrame, changes: DataFrame) -> DataFrame:
    """Every payload under one set of names: the columns of events and fields, a map from the latest name of each field to its value as JSON text.

    A field whose kind changed is text in either version, so that the column has one type. Null payloads have no fields.
    """
    renames = changes.where("change_kind = 'renamed'").groupBy("table_name").applyInPandas(_latest_names, "table_name string, old_field string, field string")
    maps = renames.groupBy("table_name").agg(F.map_from_entries(F.collect_list(F.struct("old_field", "field"))).alias("__names"))
    parsed = events.join(maps, "table_name", "left").withColumn("__p", F.from_json("after_json", "map<string,string>"))
    named = F.transform(F.map_entries("__p"), lambda e: F.struct(F.coalesce(F.try_element_at("__names", e["key"]), e["key"]).alias("key"), e["value"].alias("value")))
    # If a payload has both names, the value under the latest one is kept.
    keys = F.array_distinct(F.transform(named, lambda e: e["key"]))
    latest = F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.try_element_at("__p", k), F.element_at(F.transform(F.filter(named, lambda e: e["key"] == k), lambda e: e["value"]), 1))))
    return parsed.withColumn("fields", latest).drop("__p", "__names")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(load(spark, sf_dir, "cdc_events"), load(spark, sf_dir, "snapshots"))


def p3_likely_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The renames told from values, kinds and names alone, as if no delivery had a before image."""
    return likely_renames(load(spark, sf_dir, "cdc_events").withColumn("before_json", F.lit(None).cast("string")), load(spark, sf_dir, "snapshots")).withColumn("score", F.round("score", 3))


def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each table's unified form: fields, and in how many payloads each stands."""
    events = load(spark, sf_dir, "cdc_events").where("after_json is not null").select("table_name", "after_json", "_cdc_row_id", "_cdc_sequence")
    rows = unify(events, p3_found(spark, sf_dir))
    return rows.select("table_name", F.explode(F.map_keys("fields")).alias("field")).groupBy("table_name", "field").agg(F.count("*").alias("payloads"))
