"""Lake operators against plain Python over small, nasty inputs."""

import json
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.lake import compaction, dedupe, drift, incremental, upserts
from millrace.session import load, shared_path

CDC = "delivery_id bigint, source_do_id string, table_name string, _cdc_sequence bigint, _cdc_operation string, _cdc_row_id string, before_json string, after_json string, snapshot_id bigint, n int, block string"
SNAP = "table_name string, snapshot_id bigint, sequence_number bigint, added_files_size string, lo int"
FILES = "table_name string, snapshot_id bigint, status int, file_path string, partition_path string, record_count bigint, file_size_in_bytes bigint, n int"
RUNS = "run_id bigint, table_name string, from_snapshot_id bigint, to_snapshot_id bigint, status string, logged_at timestamp, block int"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 1. Small files


def test_small_files(spark):
    mb = 1024 * 1024
    files = [
        ("a", 1, 1, "f1", "d=1", 5, 100, 0), ("a", 1, 1, "f2", "d=1", 5, None, 0), ("a", 1, 1, "f2", "d=1", 5, None, 0), ("a", 1, 1, "f3", "d=2", 5, 200, 0),
        ("a", 1, 1, "big", "d=1", 5, 8 * mb, 0), ("a", 2, 1, "f4", None, 1, 10, 0), ("a", 2, 1, "f5", None, 1, 10, 0), ("a", 2, 1, "gone", "d=2", 1, 10, 0), ("a", 3, 2, "gone", "d=2", 1, 10, 0),
        ("b", 4, 0, "carried", "d=1", 1, 10, 0), ("b", 5, 1, "u1", "d=1", 1, None, 0), ("b", 5, 1, "u2", "d=1", 1, 50, 0), (None, 5, 1, "x", "d=1", 1, 5, 0), ("b", 6, 1, None, "d=1", 1, 5, 0),
    ]
    snaps = [("a", 1, 1, f" {8 * mb + 350}.0", 0), ("a", 1, 1, None, 0), ("a", 2, 2, None, 0), ("b", 5, 1, "8,388,700", 0)]
    f, s = spark.createDataFrame(files, FILES), spark.createDataFrame(snaps, SNAP)
    assert rows(compaction.small_files(f, s).select("file_path", "size")) == [("f1", 100), ("f2", 50), ("f4", 10), ("f5", 10)]
    plan = compaction.plan_rewrites(f, s, target=60, ranges=1)
    assert plan.count() == 4 and plan.select("target_file").distinct().count() == 3
    assert rows(compaction.plan_rewrites(f, s, target=60, ranges=4)) == rows(plan)
    assert compaction.plan_rewrites(f.limit(0), s.limit(0)).count() == 0


def test_compact_directory(spark):
    at = shared_path(spark, "tiny")
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.lit("x").alias("v"), F.expr("if(id % 5 = 0, null, id)").alias("w"))
    df.repartition(40).write.parquet(at)
    done = compaction.compact_directory(spark, at, ["k"], target=20_000)
    assert done.same and done.files_before == 40 and done.files_after < 10
    assert rows(spark.read.parquet(at).groupBy("k").count().where("count > 1")) == [(7, 1668)]
    # A swap that died between its two renames is undone.
    fs, p = compaction._fs(spark, at)
    fs.rename(p, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}.__old"))
    compaction.recover(spark, at)
    assert spark.read.parquet(at).count() == 5000


def test_checksum_counts_nulls(spark):
    sums = [compaction.checksum(spark.createDataFrame([x], "a int, b int, c array<int>, d map<string,int>")) for x in [(1, None, [1, None, 2], None), (None, 1, [1, None, 2], None), (1, None, [1, 2], None), (1, None, [1, 2], {}), (1, None, None, {"a": None})]]
    assert len(set(sums)) == 5


def test_rewrite_whole_plan(spark):
    files = [
        ("a", 1, 1, "f1", "d=1", 2, 100, 0), ("a", 1, 1, "f2", "d=1", 1, 100, 0), ("a", 2, 1, "f3", "d=1", 1, 100, 0), ("a", 3, 1, "f4", "d=1", 1, 100, 0),
        # r1 replaces f1 and f2, r2 replaces r1 and f3
        ("a", 8, 2, "f1", "d=1", 2, 100, 0), ("a", 8, 2, "f2", "d=1", 1, 100, 0), ("a", 8, 1, "r1", "d=1", 3, 100, 0),
        ("a", 9, 2, "r1", "d=1", 3, 100, 0), ("a", 9, 2, "f3", "d=1", 1, 100, 0), ("a", 9, 1, "r2", "d=1", 4, 100, 0),
        # the records of g1 are nowhere, and one of g2's two
        ("b", 4, 1, "g1", None, 70, 100, 0), ("b", 5, 1, "g2", None, 2, 100, 0), ("b", 5, 1, "g3", None, 1, 100, 0), ("c", 6, 1, "h1", "d=1", 9, 100, 0), ("c", 6, 1, "h2", "d=1", 9, 100, 0),
    ]
    snaps = [("a", i, "replace" if i > 7 else "append", "0") for i in range(1, 10)]
    f, s = spark.createDataFrame(files, FILES), spark.createDataFrame(snaps, "table_name string, snapshot_id bigint, operation string, added_files_size string")
    ev = [("a", "f1", 1, "x"), ("a", "f1", 2, "x"), ("a", "f2", 3, None), ("a", "f3", 4, "x"), ("a", "f4", 5, "x"), ("b", "g2", 6, "x"), ("b", "g3", 7, "x"), ("z", "other", 8, "x")]
    events = spark.createDataFrame(ev, "table_name string, file_path string, n int, v string")
    assert rows(compaction.current_files(f, s)) == [("a", "f1", "r2"), ("a", "f2", "r2"), ("a", "f3", "r2"), ("a", "r1", "r2")]
    plan, out = compaction.plan_rewrites(f, s), shared_path(spark, "whole")
    report = compaction.rewrite(events, plan, ["n"], out, compaction.current_files(f, s))
    # table, small files, records, unmoved, before, after, targets, reconciled
    assert rows(report) == [("a", 2, 5, 0, 5, 5, 1, True), ("b", 3, 73, 2, 2, 1, 1, False), ("c", 2, 18, 2, 0, 0, 0, False)]
    assert rows(spark.read.parquet(f"{out}.unmoved")) == [("b", "g1", 70, 0), ("b", "g2", 2, 1), ("c", "h1", 9, 0), ("c", "h2", 9, 0)]
    swap = rows(spark.read.parquet(f"{out}.entries").where("status = 2").select("file_path"))
    assert swap == [("f4",), ("g3",), ("r2",)] and spark.read.parquet(f"{out}.entries").where("status = 1").count() == 2
    moved = spark.read.parquet(out)
    assert rows(moved.select("table_name", "file_path", "n", "v")) == sorted([x for x in ev if x[0] == "a" or x[1] == "g3"], key=repr)
    assert rows(moved.select("table_name", "mr_target").distinct()) == rows(plan.where("table_name <> 'c'").select("table_name", "target_file").distinct())


# 2. Inserts, updates, deletes


def _changes(seed, n=300):
    r, out = random.Random(seed), []
    for i in range(n):
        row, seq, kind = str(r.randrange(12)), r.randrange(200), r.choice(["INSERT", "u", " Update", "D", "delete ", "c"])
        row, seq = (None, seq) if r.random() < 0.03 else (row, seq)
        out.append((i, f"s{seq % 3}", "t" if int(row or 0) % 3 else "hot", None if r.random() < 0.03 else seq, kind if seq % 17 else "DELETE", row, None, None if kind.strip().lower()[0] == "d" else json.dumps({"a": seq}), 1, 0, ""))
    # the same change always says the same
    same = {}
    return [same.setdefault((x[2], x[5], x[3]), x) for x in out]


@pytest.mark.parametrize("seed", range(3))
def test_current_rows(spark, seed, tmp_path):
    ev = _changes(seed)
    want = {}
    for x in sorted((x for x in ev if x[3] is not None and x[5] is not None), key=lambda x: x[3]):
        want[x[2], x[5]] = (x[3], x[4].strip().lower()[0] == "d")
    want = sorted((*k, s) for k, (s, gone) in want.items() if not gone)
    df = spark.createDataFrame(ev, CDC)
    assert rows(upserts.current_rows(df, ["table_name", "_cdc_row_id"])) == sorted(want, key=repr)
    t = upserts.EqualityDeleteTable(spark, str(tmp_path / "t"), ["table_name", "_cdc_row_id"], ["after_json"])
    halves = [df.where("delivery_id % 2 = 1"), df.where("delivery_id % 2 = 0")]
    t.append(halves[0], "x")
    t.append(halves[1], "y")
    t.append(halves[0], "z")  # again
    assert rows(t.read().select("table_name", "_cdc_row_id", "_cdc_sequence")) == sorted(want, key=repr)
    assert rows(t.compacted(str(tmp_path / "c")).read().select("table_name", "_cdc_row_id", "_cdc_sequence")) == sorted(want, key=repr)
    # Another object on the same path, and a batch that died before its commit.
    u = upserts.EqualityDeleteTable(spark, str(tmp_path / "t"), ["table_name", "_cdc_row_id"], ["after_json"])
    gone = df.where("table_name is not null and _cdc_row_id is not null").groupBy("table_name", "_cdc_row_id").agg(F.lit(10**9).cast("bigint").alias("__reach"))
    u._runs.write(gone.selectExpr("table_name", "_cdc_row_id", "null _cdc_sequence", "null after_json", "__reach", "'delete' mr_kind"), "dead")
    assert rows(u.read().select("table_name", "_cdc_row_id", "_cdc_sequence")) == sorted(want, key=repr)
    assert "Exchange" not in u.read()._jdf.queryExecution().sparkPlan().toString()
    assert upserts.unplaced(df, ["table_name", "_cdc_row_id"]).count() == sum(x[3] is None or x[5] is None for x in ev)
    assert upserts.current_rows(df.limit(0), ["table_name", "_cdc_row_id"]).count() == 0


def test_unknown_operations(spark, tmp_path):
    ops = [("\tdelete\n", "{}"), ("\u00a0D", "{}"), (None, None), ("?", None), (None, "{}"), ("?", "{}"), ("\tinsert", None)]
    df = spark.createDataFrame([(i, "s", "t", 1 + i, op, str(i), None, after, 1, 0, "") for i, (op, after) in enumerate(ops)], CDC)
    want = [("t", str(i), 1 + i) for i in (4, 5, 6)]
    key = ["table_name", "_cdc_row_id"]
    assert rows(upserts.current_rows(df, key)) == want
    t = upserts.EqualityDeleteTable(spark, str(tmp_path / "t"), key, ["after_json"])
    t.append(df)
    assert rows(t.read().select(*key, "_cdc_sequence")) == want
    assert rows(upserts.current_rows(df.drop("after_json"), key)) == [("t", str(i), 1 + i) for i in range(2, 7)]


# 3. Drift


def brute_drift(events, order):
    kind = lambda v: None if v is None else "s" if isinstance(v, str) else "b" if isinstance(v, bool) else "n" if isinstance(v, (int, float)) else "o" if isinstance(v, dict) else "a"
    by = defaultdict(lambda: defaultdict(list))
    for e in events:
        if e["after_json"] is not None and (e["table_name"], e["snapshot_id"]) in order:
            by[e["table_name"]][order[e["table_name"], e["snapshot_id"]]].append(json.loads(e["after_json"]))
    ids = {(t, n): s for (t, s), n in order.items()}
    out = set()
    for t, snaps in by.items():
        nums = sorted(snaps)
        carried = {n: {f for d in snaps[n] for f in d} for n in nums}
        first, last, kinds = {}, {}, defaultdict(list)
        for n in nums:
            for f in carried[n]:
                first.setdefault(f, n)
                last[f] = n
            for d in snaps[n]:
                for f, v in d.items():
                    if v is not None:
                        kinds[f].append((n, kind(v)))
        added = {(f, n) for f, n in first.items() if n != nums[0]}
        removed = {(f, nums[nums.index(n) + 1]) for f, n in last.items() if n != nums[-1]}
        for f, n in sorted(removed):
            for g, m in sorted(added):
                if n != m:
                    continue
                pairs = []
                for e in events:
                    no = order.get((t, e["snapshot_id"]))
                    if e["table_name"] == t and no is not None and no >= n and e["before_json"] and e["after_json"]:
                        b, a = json.loads(e["before_json"]), json.loads(e["after_json"])
                        if f in b and g in a:
                            pairs.append((b[f], a[g]))
                if pairs and all(x == y and isinstance(x, bool) == isinstance(y, bool) for x, y in pairs) and any(x is not None for x, _ in pairs):
                    out.add((t, ids[t, n], "renamed", f, g))
        for f, n in removed:
            if not any(r[:3] == (t, ids[t, n], "renamed") and r[3] == f for r in out):
                out.add((t, ids[t, n], "removed", f, ""))
        for f, n in added:
            if not any(r[:3] == (t, ids[t, n], "renamed") and r[4] == f for r in out):
                out.add((t, ids[t, n], "added", "", f))
        for f, ks in kinds.items():
            for s in nums:
                a, b = {k for n, k in ks if n < s}, {k for n, k in ks if n >= s}
                if len(a) == 1 and len(b) == 1 and a != b and any(n == s for n, _ in ks):
                    out.add((t, ids[t, s], "retyped", f, f))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_drift_of_tables(spark, sf):
    d = f"/root/testdata/{sf}"
    events = [r.asDict() for r in load(spark, d, "cdc_events").select("table_name", "snapshot_id", "before_json", "after_json").collect()]
    order = {(r[0], r[1]): r[2] for r in load(spark, d, "snapshots").select("table_name", "snapshot_id", "sequence_number").collect()}
    got = {tuple(r) for r in drift.p3_found(spark, d).collect()}
    assert got == brute_drift(events, order) and got


def test_drift_edges(spark):
    e = [
        ("t", 10, None, '{"a":1,"old":"x","Name":1}'), ("t", 10, None, "not json"), ("t", 20, '{"a":1,"old":"x"}', '{"a":2,"new":"x","Name":1}'), ("t", 20, '{"a":1,"old":null}', '{"a":3,"new":null}'),
        ("t", 30, None, '{"a":"5","new":"y","name":null}'), ("t", 30, None, None), ("t", 99, None, '{"lost":1}'), (None, 10, None, '{"z":1}'), ("t", 40, None, '[1]'), ("u", 1, None, '{"a":{}}'),
    ]
    ev = spark.createDataFrame([(i, "s", t, i, "u", "1", b, a, s, 0, "") for i, (t, s, b, a) in enumerate(e)], CDC)
    sn = spark.createDataFrame([("t", 10, 1, "", 0), ("t", 20, 2, "", 0), ("t", 20, 2, "", 0), ("t", 30, 3000, "", 0), ("t", 40, 3001, "", 0), ("u", 1, 1, "", 0)], SNAP)
    got = {tuple(r)[1:] for r in drift.schema_changes(ev, sn).collect()}
    assert got == {
        (20, "renamed", "old", "new"), (30, "removed", "Name", ""), (30, "added", "", "name"), (30, "retyped", "a", "a"), (40, "removed", "a", ""), (40, "removed", "new", ""), (40, "removed", "name", ""),
    }
    fields = drift.unify(ev.where("delivery_id < 3"), drift.schema_changes(ev, sn)).orderBy("delivery_id").select("fields").collect()
    assert fields[0][0]["new"] == "x" and "old" not in fields[0][0]
    assert drift.schema_changes(ev.limit(0), sn.limit(0)).count() == 0


def test_likely_renames(spark):
    old = [("t", 10, None, json.dumps({"id": i, "colour": f"c{i % 7}", "qty": i})) for i in range(40)]
    new = [("t", 20, None, json.dumps({"id": i, "paint": f"c{i % 7}", "note": f"n{i}"})) for i in range(40)]
    ev = spark.createDataFrame([(i, "s", t, i, "c", "1", b, a, s, 0, "") for i, (t, s, b, a) in enumerate(old + new)], CDC)
    sn = spark.createDataFrame([("t", 10, 1, "", 0), ("t", 20, 2, "", 0)], SNAP)
    got = rows(drift.likely_renames(ev, sn).select("snapshot_id", "old_field", "new_field"))
    assert got == [(20, "colour", "paint")]
    assert drift.likely_renames(ev.limit(0), sn).count() == 0
    assert {tuple(r)[2] for r in drift.schema_changes(ev, sn).collect()} == {"added", "removed"}


def test_assignment():
    rng = np.random.default_rng(0)
    from itertools import permutations

    for _ in range(30):
        w = rng.integers(-2, 6, (rng.integers(1, 5), rng.integers(1, 5))).astype(float)
        big = np.zeros((max(w.shape),) * 2)
        big[: w.shape[0], : w.shape[1]] = np.maximum(w, 0)
        best = max(sum(big[i, p[i]] for i in range(len(big))) for p in permutations(range(len(big))))
        got = drift.assignment(w)
        assert sum(w[i, j] for i, j in got) == best and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)


# 4. Only what is new


@pytest.mark.parametrize("seed", range(3))
def test_intervals(spark, seed):
    r = random.Random(seed)
    iv = [(r.choice("ab"), lo, lo + r.randrange(0, 3000)) for lo in (r.randrange(0, 20000) for _ in range(40))]
    have = [("a", 0, 25000), ("b", 100, 9000), ("c", 5, 6)]
    done = {(k, x) for k, lo, hi in iv for x in range(lo + 1, hi + 1)}
    a, d = spark.createDataFrame(have, "k string, lo bigint, hi bigint"), spark.createDataFrame(iv, "k string, lo bigint, hi bigint")
    merged = incremental.merge_intervals(d, ["k"]).collect()
    got = [(x["k"], i) for x in merged for i in range(x["lo"] + 1, x["hi"] + 1)]
    assert len(got) == len(set(got)) and set(got) == done
    gaps = {(x["k"], i) for x in incremental.subtract_intervals(a, d, ["k"]).collect() for i in range(x["lo"] + 1, x["hi"] + 1)}
    assert gaps == {(k, x) for k, lo, hi in have for x in range(lo + 1, hi + 1)} - done


def test_pending(spark):
    import datetime

    at = lambda m: datetime.datetime(2025, 1, 1, 0, m)
    runs = [
        (1, "t", None, 10, "running", at(1), 0), (1, "t", None, 10, " Succeeded", at(2), 0), (2, "t", 10, 30, "succeeded", at(3), 0), (2, "t", 10, 30, "FAILED", at(4), 0), (3, "t", 20, 30, "succeeded", at(5), 0),
        (4, "t", 77, 30, "succeeded", at(6), 0), (5, "t", 10, None, "succeeded", at(6), 0), (6, None, None, 10, "succeeded", None, 0),
    ]
    ev = [(1, "s", "t", 1, 10), (2, "s", "t", 2, 20), (3, "s", "t", 3, 30), (4, "s", "t", 2, 30), (5, "s", "t", 4, 20), (6, "s", "v", 5, 50), (7, "s", "t", 6, 99), (8, None, "t", 7, 99), (9, "s", "t", None, 99)]
    df = spark.createDataFrame([(i, s, t, q, "u", "1", None, None, n, 0, "") for i, s, t, q, n in ev], CDC)
    sn = spark.createDataFrame([("t", 10, 1, "", 0), ("t", 20, 2, "", 0), ("t", 30, 3, "", 0), ("t", 30, 3, "", 0), ("v", 50, 1, "", 0)], SNAP)
    rn = spark.createDataFrame(runs, RUNS)
    assert rows(incremental.pending_changes(df, sn, rn)) == [("s", 4), ("s", 5), ("s", 6)]
    assert incremental.pending_changes(df.limit(0), sn, rn).count() == 0
    assert incremental.pending_changes(df, sn.limit(0), rn.limit(0)).count() == 6


def test_ledger(spark, tmp_path):
    led = incremental.IntervalLedger(spark, str(tmp_path / "l"))
    df = spark.createDataFrame([("a", i, i * i) for i in range(20)], "src string, seq bigint, v bigint")
    first = led.pending(df.where("seq < 10 and seq <> 4"), "src", "seq")
    with pytest.raises(RuntimeError):
        led.commit("r1", first, "src", "seq", fail_before_commit=True)
    assert led.output() is None and led.pending(df, "src", "seq").count() == 20
    assert led.commit("r1", first, "src", "seq") and not led.commit("r1", first, "src", "seq")
    late = led.pending(df, "src", "seq")
    assert sorted(r["seq"] for r in late.collect()) == [4, *range(10, 20)]
    led.commit("r2", late, "src", "seq")
    assert rows(led.output()) == rows(df) and led.pending(df, "src", "seq").count() == 0
    # What a run filtered out isn't given to it again.
    more = df.withColumn("seq", F.col("seq") + 100)
    led.commit("r3", more.where("seq % 2 = 0"), "src", "seq", taken=more)
    assert led.pending(more, "src", "seq").count() == 0 and led.output().count() == 30


def test_rows_changed_by_key(spark):
    from millrace.lake.tables import LakeTable

    t = LakeTable.create(spark, shared_path(spark, "rows"), "id int, v string")
    mk = lambda *x: spark.createDataFrame(list(x), "id int, v string")
    t.append(mk((1, "a"), (2, "b"), (3, "c"), (None, "n")))
    t.change(mk((2, "")), mk((2, "B")), ["id"])
    t.append(mk((4, "d")))
    t.alter(rename={"id": "key"})
    t.change(mk((3, ""), (4, "")).withColumnRenamed("id", "key"), None, ["key"])
    t.append(mk((3, "again")).withColumnRenamed("id", "key"))
    assert rows(t.read()) == sorted([(1, "a"), (2, "B"), (3, "again"), (None, "n")], key=repr)
    assert rows(t.read(version=2)) == sorted([(1, "a"), (2, "B"), (3, "c"), (None, "n")], key=repr)
    before = rows(t.read())
    t.compact(["key"])
    assert rows(t.read()) == before and not t.head()["deletes"]
    # A directory that a writer is about to commit stays.
    head = t.head()
    new = t._store(t._shaped(mk((9, "z")).withColumnRenamed("id", "key"), head), head)
    t.prune(retain=1)
    t.commit("append", [*head["dirs"], new], "main", head)
    assert t.read().where("key = 9").count() == 1 and t.prune(retain=1, grace=0) > 0 and t.read().count() == 5


# 5. Once each


@pytest.mark.parametrize("seed", range(3))
def test_request_messages(spark, seed):
    r = random.Random(seed)
    req = [(i, f"s{r.randrange(30)}" if r.random() > 0.05 else None, str(r.randrange(12)) if r.random() > 0.05 else None, r.choice([None, "", "  ", f"K{r.randrange(60)}", f" k{r.randrange(60)} "])) for i in range(200)]
    req += [(1000 + i, "x", str(i // 2), f"chain{(i + 1) // 2}") for i in range(101)]  # one long chain
    root = {x[0]: x[0] for x in req}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    seen = {}
    for i, s, n, k in req:
        for link in ([("id", s, n)] if s is not None and n is not None else []) + ([("k", k.strip().lower())] if k and k.strip() else []):
            if link in seen:
                a, b = sorted((top(i), top(seen[link])))
                root[b] = a
            seen[link] = i
    df = spark.createDataFrame([(*x, 0, "c") for x in req], "delivery_id bigint, session_id string, id string, idempotency_key string, m int, root string")
    assert rows(dedupe.request_messages(df)) == sorted([(i, top(i)) for i in root], key=repr)
    assert dedupe.request_messages(df.limit(0)).count() == 0


def test_superfluous_and_store(spark, tmp_path):
    df = spark.createDataFrame([(3, "a", 1), (1, "a", 1), (2, "a", 1), (4, "b", 1), (5, None, 1), (6, None, 1), (7, "c", None), (8, "hot", 9)] + [(100 + i, "hot", 9) for i in range(500)], "delivery_id bigint, s string, q bigint")
    assert rows(dedupe.superfluous(df, ["s", "q"], "delivery_id").select("delivery_id").where("delivery_id < 100")) == [(2,), (3,)]
    assert dedupe.superfluous(df, ["s", "q"], "delivery_id").count() == 502
    st = dedupe.MessageStore(spark, str(tmp_path / "m"), ["s", "q"], "delivery_id", buckets=4)
    ok = df.where("s is not null and q is not null")
    st.upsert(ok.where("delivery_id > 2"), "b1")
    st.upsert(ok.where("delivery_id > 2"), "b1")
    st.upsert(ok.where("delivery_id < 50"), "b2")
    want = [("a", 1, 1), ("b", 1, 4), ("hot", 9, 8)]
    assert rows(st.read().select("s", "q", "delivery_id")) == want == rows(st.compacted(str(tmp_path / "n")).read().select("s", "q", "delivery_id"))
    with pytest.raises(ValueError):
        st.upsert(df)
    assert dedupe.superfluous(df.limit(0), ["s", "q"], "delivery_id").count() == 0
    # A message under a third of all rows, resolved with its edges joined apart.
    star = spark.createDataFrame([(i, 0) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(40)], "a bigint, b bigint")
    assert rows(dedupe.components(star, hot=5)) == sorted([(i, 0) for i in range(1, 300)] + [(1001 + i, 1000) for i in range(40)], key=repr)
