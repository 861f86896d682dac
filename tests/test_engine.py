"""Dialect, database, lake tables, sources, streams and search on small inputs."""

import datetime
import re
import time

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, jsons, strings
from millrace.lake.partitioning import bucket, bucket_fnv
from millrace.lake.tables import Conflict, LakeTable
from millrace.operators import relational as rel
from millrace.operators.search import match, parse_query, snippet
from millrace.plans.database import ConstraintError, Database, affinity
from millrace.plans.dialect import glob_regex, translate
from millrace.session import shared_path
from millrace.sources.readers import detect_format, read_source
from millrace.streaming.changelog import Slots, Subscription, by_hlc


def one(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def db(spark):
    d = Database(spark)
    d.sql("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT NOT NULL, v REAL DEFAULT 1.5 CHECK (v >= 0), dbl REAL GENERATED ALWAYS AS (v * 2))")
    d.sql("INSERT INTO t (id, name, v) VALUES (1, 'a', 1), (2, 'it''s', 2), (3, 'c', 3)")
    return d


def test_dialect(spark):
    assert one(spark.sql(translate("SELECT 'it''s' || '\\n' AS x, \"y\" FROM (SELECT 1 AS y) WHERE 'ABC' LIKE 'a_c' AND 'abc' GLOB 'a[a-c]*'")[0])) == [("it's\\n", 1)]
    assert translate("SELECT ?, ?2, :a, @b, $3")[1] == ["p1", "p2", "a", "b", "p3"]
    for q, want in (("1 < ALL (SELECT 5 WHERE FALSE)", True), ("1 = ANY (SELECT 5 WHERE FALSE)", False), ("3 > ANY (VALUES (1), (9))", True), ("3 > ALL (VALUES (1), (NULL))", False), ("2 <> ALL (VALUES (1), (3))", True), ("2 <> ANY (VALUES (2))", False), ("2 IN ()", False), ("2 NOT IN ()", True), ("NULL IS 3", False), ("2 IS NOT 3", True)):
        assert one(spark.sql(translate(f"SELECT count(*) FROM (SELECT 1) WHERE {q}")[0])) == [(int(want),)], q
    import re

    assert re.match(glob_regex("a?[0-9]*"), "ab7zz") and not re.match(glob_regex("a?"), "abc") and re.match(glob_regex("[^x].y"), "a.y")
    with pytest.raises(ValueError):
        translate("SELECT \x01")


def test_affinity():
    assert [affinity(x) for x in ("BIGINT", "varchar(5)", "BLOB", "", "double", "decimal(3,1)")] == ["INTEGER", "TEXT", "BLOB", "BLOB", "REAL", "NUMERIC"]


def test_changes(db):
    assert one(db.sql("INSERT INTO t (id, name) VALUES (4, 'd') RETURNING id, v, dbl")) == [(4, 1.5, 3.0)]
    for bad in ("INSERT INTO t (id, name) VALUES (1, 'x')", "INSERT INTO t (id, name) VALUES (9, NULL)", "INSERT INTO t (id, name, v) VALUES (9, 'x', -1)", "UPDATE t SET v = -5 WHERE id = 1", "UPDATE t SET id = 1 WHERE id = 2"):
        with pytest.raises(ConstraintError):
            db.sql(bad)
    assert one(db.sql("INSERT INTO t (id, name, v) VALUES (1, 'z', 9) ON CONFLICT (id) DO UPDATE SET v = t.v + excluded.v, name = excluded.name RETURNING id, name, v".replace("t.v", "v"))) == [(1, "z", 10.0)]
    assert one(db.sql("INSERT INTO t (id, name) VALUES (1, 'q') ON CONFLICT DO NOTHING")) == [(0,)]
    assert one(db.sql("UPDATE t SET v = v + 1 WHERE id >= ? ORDER BY id LIMIT 1 RETURNING id, v, dbl", [2])) == [(2, 3.0, 6.0)]
    assert one(db.sql("DELETE FROM t WHERE name = :n", {"n": "it's"})) == [(1,)]
    assert one(db.sql("SELECT count(*) FROM t AS OF VERSION 1")) == [(3,)]
    assert sorted(one(db.sql("SELECT id FROM t"))) == [(1,), (3,), (4,)]
    with pytest.raises(PermissionError):
        Database(db.spark, db.path, read_only=True).sql("DELETE FROM t")


def test_transactions(db):
    db.sql("BEGIN")
    db.sql("DELETE FROM t WHERE id = 1")
    db.sql("SAVEPOINT s1")
    db.sql("DELETE FROM t")
    db.sql("ROLLBACK TO s1")
    assert one(db.sql("SELECT count(*) FROM t")) == [(2,)]
    db.sql("ROLLBACK")
    assert one(db.sql("SELECT count(*) FROM t")) == [(3,)]


def test_foreign_keys_views_triggers(db):
    db.sql("CREATE TABLE u (id INTEGER PRIMARY KEY, t_id INTEGER REFERENCES t(id))")
    db.sql("INSERT INTO u VALUES (1, 1), (2, NULL)")
    with pytest.raises(ConstraintError):
        db.sql("INSERT INTO u VALUES (3, 77)")
    db.sql("DELETE FROM t WHERE id = 1")
    assert one(db.sql("PRAGMA foreign_key_check(u)").select("parent")) == [("t",)]
    db.sql("CREATE VIEW big AS SELECT id, v FROM t WHERE v > 2")
    assert one(db.sql("SELECT b.id FROM big AS b JOIN t ON t.id = b.id")) == [(3,)]
    with pytest.raises(ValueError):
        db.sql("DROP TABLE t")
    db.trigger("up", "before", "insert", "t", lambda d, r: r.withColumn("name", F.upper("name")))
    assert one(db.sql("INSERT INTO t (id, name) VALUES (8, 'low') RETURNING name")) == [("LOW",)]
    db.sql("CREATE UNIQUE INDEX i ON t (name)")
    with pytest.raises(ConstraintError):
        db.sql("INSERT INTO t (id, name) VALUES (10, 'LOW')")
    assert any("Scan" in r[0] for r in db.sql("EXPLAIN SELECT * FROM t").select("detail").collect())


def test_transactions_are_isolated(db):
    other = Database(db.spark, db.path)
    db.sql("BEGIN")
    db.sql("UPDATE t SET v = 9 WHERE id = 1")
    db.sql("INSERT INTO t (id, name) VALUES (7, 'new')")
    assert one(other.sql("SELECT count(*), max(v) FROM t")) == [(3, 3.0)] and one(db.sql("SELECT count(*), max(v) FROM t")) == [(4, 9.0)]
    db.sql("COMMIT")
    assert one(other.sql("SELECT count(*), max(v) FROM t")) == [(4, 9.0)]
    db.sql("BEGIN")
    db.sql("DELETE FROM t WHERE id = 7")
    other.sql("UPDATE t SET name = 'x' WHERE id = 2")
    with pytest.raises(Conflict):
        db.sql("COMMIT")
    assert one(db.sql("SELECT count(*) FROM t WHERE id = 7 OR name = 'x'")) == [(2,)]
    with pytest.raises(ConstraintError):
        db.sql("BEGIN")
        db.sql("DELETE FROM t")
        db.sql("INSERT OR ROLLBACK INTO t (id, name) VALUES (20, NULL)")
    assert db._txn is None and one(db.sql("SELECT count(*) FROM t")) == [(4,)]
    with pytest.raises(ConstraintError):
        db.sql("INSERT OR FAIL INTO t (id, name) VALUES (30, 'ok'), (31, NULL), (1, 'again')")
    assert sorted(one(db.sql("SELECT id FROM t WHERE id >= 30"))) == [(30,)]


def test_one_row_update_writes_one_row(db):
    dirs = [d["dir"] for d in db.lake("t").head()["dirs"]]
    db.sql("UPDATE t SET v = 8 WHERE id = 2")
    head = db.lake("t").head()
    new = [d["dir"] for d in head["dirs"] if d["dir"] not in dirs]
    assert len(new) == 1 and db.spark.read.parquet(f"{db.lake('t').path}/data/{new[0]}").count() == 1 and len(head["deletes"]) == 1


def test_sql_triggers(db):
    db.sql("CREATE TABLE log (what TEXT, old REAL, new REAL)")
    db.sql("CREATE TRIGGER a AFTER UPDATE OF v ON t WHEN NEW.v > OLD.v BEGIN INSERT INTO log VALUES ('up ' || NEW.name, OLD.v, NEW.v); END")
    db.sql("CREATE TRIGGER b BEFORE DELETE ON t BEGIN SELECT RAISE(ABORT, 'a stays') WHERE OLD.name = 'a'; SELECT CASE WHEN OLD.v >= 3 THEN RAISE(IGNORE) END; END;")
    db.sql("CREATE TRIGGER c AFTER INSERT ON t FOR EACH ROW BEGIN UPDATE t SET name = upper(name) WHERE id = NEW.id; DELETE FROM log WHERE log.new < NEW.v; END")
    db.sql("UPDATE t SET v = v + 5 WHERE id < 3")
    db.sql("UPDATE t SET v = v - 1 WHERE id = 1")
    db.sql("UPDATE t SET name = 'z' WHERE id = 3")
    assert sorted(one(db.sql("SELECT * FROM log"))) == [("up a", 1.0, 6.0), ("up it's", 2.0, 7.0)]
    with pytest.raises(ConstraintError, match="a stays"):
        db.sql("DELETE FROM t")
    db.sql("DELETE FROM t WHERE id = 3")
    assert one(db.sql("SELECT count(*) FROM t")) == [(3,)]
    again = Database(db.spark, db.path)  # triggers and tables are found again
    again.sql("INSERT INTO t (id, name, v) VALUES (5, 'low', 6.5)")
    assert one(again.sql("SELECT name FROM t WHERE id = 5")) == [("LOW",)] and one(again.sql("SELECT new FROM log")) == [(7.0,)]
    again.sql("CREATE VIEW names AS SELECT id, name FROM t GROUP BY id, name")
    again.sql("CREATE TRIGGER d INSTEAD OF INSERT ON names BEGIN INSERT INTO t (id, name) VALUES (NEW.id, NEW.name); END")
    again.sql("CREATE TRIGGER e INSTEAD OF UPDATE ON names BEGIN UPDATE t SET name = NEW.name WHERE id = OLD.id; END")
    again.sql("CREATE TRIGGER f INSTEAD OF DELETE ON names BEGIN UPDATE t SET v = 0 WHERE id = OLD.id; END")
    again.sql("INSERT INTO names VALUES (6, 'six')")
    again.sql("UPDATE names SET name = 'sechs' WHERE id = 6")
    again.sql("DELETE FROM names WHERE id = 6")
    assert one(again.sql("SELECT name, v FROM t WHERE id = 6")) == [("sechs", 0.0)]
    again.sql("DROP TRIGGER d")
    with pytest.raises(ValueError):
        again.sql("INSERT INTO names VALUES (7, 'x')")


def test_foreign_actions_views_explain(db):
    db.sql("CREATE TABLE kid (id INTEGER PRIMARY KEY, p INTEGER REFERENCES t(id) ON DELETE CASCADE ON UPDATE CASCADE)")
    db.sql("CREATE TABLE pet (id INTEGER, p INTEGER, FOREIGN KEY (p) REFERENCES t(id) ON DELETE SET NULL)")
    db.sql("CREATE TABLE toy (id INTEGER, k INTEGER REFERENCES kid(id) ON DELETE RESTRICT)")
    db.sql("INSERT INTO kid VALUES (1, 1), (2, 2), (3, 1)")
    db.sql("INSERT INTO pet VALUES (1, 1), (2, 2), (2, 2)")
    db.sql("INSERT INTO toy VALUES (1, 2)")
    db.sql("UPDATE t SET id = 11 WHERE id = 1")
    assert sorted(one(db.sql("SELECT id, p FROM kid"))) == [(1, 11), (2, 2), (3, 11)]
    db.sql("DELETE FROM t WHERE id = 11")
    assert one(db.sql("SELECT id FROM kid")) == [(2,)]
    with pytest.raises(ConstraintError):
        db.sql("DELETE FROM t WHERE id = 2")
    db.sql("CREATE VIEW big AS SELECT * FROM t WHERE v > 2 WITH CHECK OPTION")
    db.sql("INSERT INTO big (id, name, v) VALUES (40, 'in', 3)")
    with pytest.raises(ConstraintError):
        db.sql("INSERT INTO big (id, name, v) VALUES (41, 'out', 1)")
    db.sql("CREATE MATERIALIZED VIEW sums AS SELECT count(*) AS n FROM t")
    db.sql("DELETE FROM t WHERE id = 40")
    n = one(db.sql("SELECT n FROM sums"))[0][0]
    db.sql("REFRESH MATERIALIZED VIEW sums")
    assert one(db.sql("SELECT n FROM sums")) == [(n - 1,)]
    text = lambda q: "\n".join(r["detail"] for r in db.sql(q).collect())
    import json

    assert json.loads(text("EXPLAIN FORMAT JSON SELECT * FROM t"))["children"] is not None
    assert "numOutputRows" in text("EXPLAIN ANALYZE FORMAT TREE SELECT count(*) FROM t") and "operator:" in text("EXPLAIN FORMAT=YAML SELECT 1")


def test_lake_versions(spark):
    t = LakeTable.create(spark, shared_path(spark, "t"), "k int, v string")
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    head = t.head()
    t.append(a)
    with pytest.raises(Conflict):
        t.append(a, on=head)
    t.branch("dev")
    t.overwrite(spark.createDataFrame([(1, "ours"), (2, "b")], "k int, v string"))
    t.overwrite(spark.createDataFrame([(1, "theirs"), (2, "b"), (3, "c")], "k int, v string"), branch="dev")
    with pytest.raises(Conflict):
        t.merge("dev", ["k"])
    assert t.compare("main", "dev") == (1, 1) and t.merge_base("main", "dev")["lsn"] == 1
    t.merge("dev", ["k"], strategy="theirs")
    assert sorted(one(t.read())) == [(1, "theirs"), (2, "b"), (3, "c")]
    assert sorted(one(t.read(version=0))) == []
    with pytest.raises(LookupError):
        t.read(version=99)
    t.drop_branch("dev")
    assert t.prune(retain=1) == 0 and t.prune(retain=1, grace=0) >= 2 and t.read().count() == 3
    t.branch("ff")
    t.append(a.limit(1), branch="ff")
    t.merge("ff", ["k"])
    assert t.head()["id"] == t.head("ff")["id"]


def test_three_way_deletes(spark):
    mk = lambda x: spark.createDataFrame(x, "k int, v int")
    m = rel.three_way_merge(mk([(1, 1), (2, 2), (3, 3), (4, 4)]), mk([(1, 1), (3, 9), (4, 4)]), mk([(2, 2), (1, 5), (4, 4)]), ["k"])
    assert sorted((r.k, r.v, r._side) for r in m.collect()) == [(1, 5, "theirs"), (3, 9, "conflict"), (4, 4, "base")]


def test_diff_sees_moved_nulls(spark):
    t = "k int, a int, b int, c array<int>"
    old = spark.createDataFrame([(1, 1, None, [1]), (2, 5, 5, [1, None, 2]), (3, 7, None, [None]), (None, 1, None, None), (5, 1, 1, [1])], t)
    new = spark.createDataFrame([(1, None, 1, [1]), (2, 5, 5, [1, 2]), (3, 7, None, [None]), (None, None, 1, None), (6, 1, 1, [1])], t)
    want = [(1, "UPDATE"), (2, "UPDATE"), (5, "DELETE"), (6, "INSERT"), (None, "UPDATE")]
    assert sorted(map(tuple, rel.version_diff(old, new, ["k"]).select("k", "_change_type").collect()), key=repr) == want
    lake = LakeTable.create(spark, shared_path(spark, "lake"), old.schema)
    lake.append(old)
    lake.overwrite(new)
    assert sorted(map(tuple, lake.diff(1, 2, ["k"]).select("k", "_change_type").collect()), key=repr) == want


def test_joins(spark):
    l = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), (None, 3, 3)], "k string, at int, x int")  # noqa: E741
    r = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), (None, 1, 7)], "k string, t int, y int")
    assert sorted(one(rel.as_of_join(l, r, ["k"], "at", "t", ["y"])), key=repr) == sorted([("a", 5, 1, 50), ("a", 1, 2, None), (None, 3, 3, 7)], key=repr)
    assert one(rel.reference_join(l, r, "k", most_bytes=0).select("x", "y").where("x = 2 and y = 20")) == [(2, 20)]


def test_recursion(spark):
    seed = spark.createDataFrame([(0,)], "n int")
    assert sorted(r[0] for r in rel.recursive_distinct(seed, lambda d: d.select(((F.col("n") + 7) % 5).alias("n"))).collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(RuntimeError):
        rel.recursive_distinct(seed, lambda d: d.select(F.col("n") + 1), max_rounds=3)


def test_dates(spark):
    def ev(c):
        return spark.range(1).select(c.alias("x")).first()[0]

    ts = lambda s: F.lit(s).cast("timestamp")
    assert ev(dates.date(ts("2024-01-31"), "+1 month")) == "2024-03-02"
    assert ev(dates.date(ts("2024-02-29"), "+1 year")) == "2025-03-01"
    assert ev(dates.date(ts("2024-01-01"), "weekday 1")) == "2024-01-08"
    assert ev(dates.datetime(dates.parse(F.lit("12:30")))) == "2000-01-01 12:30:00"
    assert ev(dates.date(dates.parse(F.lit("2460310.5")))) == "2024-01-01"
    assert ev(dates.parse(F.lit("nonsense"))) is None
    assert ev(dates.timediff(ts("2024-01-01 00:00:00"), ts("2024-01-02 01:00:00.5"))) == "-25:00:00.500"


def test_strings_and_json(spark):
    def ev(c):
        return spark.range(1).select(c.alias("x")).first()[0]

    assert [ev(strings.substr(F.lit("hello"), a, b)) for a, b in ((0, 2), (-3, 2), (-10, 7), (2, None), (2, -1))] == ["he", "ll", "hello", "ello", ""]
    assert ev(strings.char(F.lit(8364), F.lit(65))) == "€A" and ev(strings.printf("%5s|%g|%x", F.lit(None).cast("string"), F.lit(0.0001), F.lit(255))) == " NULL|0.0001|ff"
    j = F.lit('{"a":[1,2],"b":{"c":null}}')
    assert ev(jsons.json_set(j, "$.a[#]", F.lit("3"), '$."b".d', F.lit('"x"'))) == '{"a":[1,2,3],"b":{"c":null,"d":"x"}}'
    assert ev(jsons.json_insert(j, "$.a[0]", F.lit("9"))) == '{"a":[1,2],"b":{"c":null}}' and ev(jsons.json_replace(j, "$.z", F.lit("9"))) == '{"a":[1,2],"b":{"c":null}}'
    assert ev(jsons.json_set(j, "$.p", F.lit("1"), "$.q", F.lit("2"), "$.r", F.lit("3"), "$.s", F.lit("4"))).endswith('"p":1,"q":2,"r":3,"s":4}')
    assert ev(jsons.json_remove(j, "$.a[0]", "$.b")) == '{"a":[2]}' and ev(jsons.json_patch(j, F.lit('{"a":null,"n":1}'))) == '{"b":{"c":null},"n":1}'
    assert [ev(jsons.json_type(j, p)) for p in ("$", "$.a", "$.a[0]", "$.b.c", "$.zz")] == ["object", "array", "integer", "null", None]
    assert ev(jsons.json_valid(F.lit("{x"))) == 0 and ev(jsons.json_set(F.lit("{x"), "$.a", F.lit("1"))) is None
    with pytest.raises(ValueError):
        jsons.steps("a.b")


def test_sources(spark, tmp_path):
    assert [detect_format(*a).format for a in (("x.csv.gz",), ("x", "application/json; charset=utf8"), ("x", None, b"PAR1"), ("x", None, b'{"a":1}\n{"a":2}\n'), ("x", None, b"a,b\n1,2\n3,4\n"), ("x",))] == ["csv", "json", "parquet", "ndjson", "csv", "text"]
    (tmp_path / "q.csv").write_text('a;b\n1;"x;""y"\n2;\n')
    assert one(read_source(spark, str(tmp_path / "q.csv"), delimiter=";")) == [(1, 'x;"y'), (2, None)]
    (tmp_path / "n.json").write_text('[{"a":1},{"a":"z","b":[1]}]')
    assert read_source(spark, str(tmp_path / "n.json")).count() == 2
    assert one(Database(spark).sql(f"SELECT a FROM '{tmp_path}/q.csv' WITH (delimiter = ';') WHERE a = 2")) == [(2,)]


def test_slots(spark):
    s = Slots(spark, shared_path(spark, "slots"))
    log = spark.createDataFrame([(i, "t" if i % 2 else "u", "insert") for i in range(10)], "lsn bigint, table_name string, op string")
    s.create("a", tables=["t"])
    s.acknowledge("a", 4)
    s.acknowledge("a", 2)
    assert s.position("a") == 4 and [r[0] for r in s.read("a", log).collect()] == [5, 7, 9] and s.list() == ["a"]


def test_bucket(spark):
    got = spark.createDataFrame([("abc",), ("",), (None,)], "x string").select(bucket(F.col("x"), 16)).collect()
    assert [r[0] for r in got] == [96354 % 16, 0, None]


def test_by_hlc(spark):
    log = [(1, "INSERT", (5, 0, "b")), (2, "UPDATE", (5, 0, "a")), (3, "BEGIN", (1, 0, "a")), (4, "DELETE", None), (5, "INSERT", (2, 10, "a")), (6, "INSERT", (2, 9, "a")), (7, "UPDATE", (1, 0, "z"))]
    df = spark.createDataFrame(log, "lsn bigint, op string, hlc struct<physicalTime: bigint, logicalCounter: int, nodeId: string>")
    assert [r["lsn"] for r in by_hlc(df).collect()] == [7, 6, 5, 2, 1]
    assert [r["lsn"] for r in by_hlc(df, Subscription(after_lsn=5)).collect()] == [7, 6]


def test_bucket_fnv(spark):
    def js(t):
        h, b = 2166136261, t.encode("utf-16-be")
        for i in range(0, len(b), 2):
            h ^= b[i] << 8 | b[i + 1]
            h = int(float(h - 2**32 if h >= 2**31 else h) * 16777619.0) % 2**32
        return f"{h % 16:04d}"

    texts = ["", "a", "order-17", "Zürich", "😀 x", "12345678901234567890"]
    got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", bucket_fnv(F.col("t"), 16)).collect()
    assert dict(map(tuple, got)) == {t: js(t) for t in texts} | {None: "__null__"}


def test_search(spark):
    d = spark.createDataFrame([(1, "The quick brown fox"), (2, "quick, very quick Fox brown"), (3, None), (4, "")], "id int, text string")
    find = lambda q: [r[0] for r in match(d, q, ["text"]).orderBy("id").collect()]
    assert find("quick fox") == [1, 2] and find('"brown fox"') == [1] and find("qui* NOT the") == [2] and find("NEAR(quick brown, 1)") == [1] and find("zebra OR very") == [2] and find("text:fox AND (the OR none)") == [1]
    for bad in ("(a", "a )", "NOT"):
        with pytest.raises(ValueError):
            parse_query(bad if bad != "NOT" else "a NOT")
    s = d.where("id = 2").select(snippet(F.col("text"), "brown", 2)).first()[0]
    assert s == "...Fox brown"


def test_snippet_first_best(spark):
    def slow(text, ws, size):
        w = re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ").split(" ")
        hit = [re.sub(r"[\W_]", "", x.lower()) in ws for x in w]
        at = max(range(max(1, len(w) - size + 1)), key=lambda i: (sum(hit[i : i + size]), -i))
        return "..." * (at > 0) + " ".join(w[at : at + size]) + "..." * (at + size < len(w))

    texts = ["", " ", "Fox", "a b c d", "a fox b c fox, d e FOX f", "fox " * 9, "a\n\tb  é (quick) fox-hunt fox's _ fox", "a " * 20 + "quick a fox " + "b " * 5 + "fox quick"]
    d = spark.createDataFrame([*enumerate(texts), (99, None)], "id int, text string")
    for query, ws in (("fox", {"fox"}), ("quick OR fox", {"quick", "fox"}), ("fo*", set())):
        for size in (1, 2, 3, 12):
            got = dict(map(tuple, d.select("id", snippet(F.col("text"), query, size)).collect()))
            assert got == {i: slow(t, ws, size) for i, t in enumerate(texts)} | {99: None}


def test_snippet_of_long_text(spark):
    """Time in proportion to the text: words are taken from it once, not once for each stretch."""
    d = spark.createDataFrame([("fox " + "a " * 5_000 + "fox b fox " + "c " * 5_000,), ("fox " * 10_000,)], "text string")
    d.select(snippet(F.left("text", F.lit(9)), "fox", 3)).collect()  # Spark's own start isn't counted
    began = time.time()
    assert [r[0] for r in d.select(snippet(F.col("text"), "fox", 3)).collect()] == ["...fox b fox...", "fox fox fox..."]
    assert time.time() - began < 20


def test_log_and_push(spark):
    from millrace.streaming.wal import Log, Push

    log, slots = Log(spark, shared_path(spark, "wal")), Slots(spark, shared_path(spark, "slots"))
    assert log.read() is None and log.last() == -1 and log.append(spark.range(0), [F.asc("id")]) is None
    assert log.append(spark.range(10), [F.desc("id")]) == (0, 9) and log.append(spark.range(10, 15), [F.asc("id")]) == (10, 14)
    assert [r["id"] for r in log.read(7).orderBy("lsn").collect()] == [1, 0, 10, 11, 12, 13, 14] and log.read(3, 2).count() == 2
    slots.create("s")
    got = []

    def handle(batch, first, last):
        if first == 6:
            raise OSError("never")
        got.extend(r["lsn"] for r in batch.collect())

    dead = shared_path(spark, "dead")
    p = Push(log, slots, "s", handle, size=6, retries=1, wait=0.0, dead_letters=dead)
    p.pause()
    assert p.run() == 0
    p.resume()
    assert p.run() == 3 and sorted(got) == [*range(6), 12, 13, 14] and slots.position("s") == 14 and spark.read.parquet(f"{dead}/*").count() == 6
    assert log.prune(9) == 1 and log.segments() == [(10, 14)]


def test_small_parts(spark, tmp_path):
    from millrace.plans import procedures as pr
    from millrace.plans import triggers as tr
    from millrace.sources.readers import metadata_aggregate, write_sink

    d = Database(spark)
    d.sql("CREATE TABLE s (id INTEGER PRIMARY KEY, deleted_at TIMESTAMP)")
    d.sql("INSERT INTO s (id) VALUES (1), (2)")
    d.trigger("soft", "before", "delete", "s", tr.soft_delete(table="s"))
    d.sql("DELETE FROM s WHERE id = 1")
    assert one(d.sql("SELECT id FROM s WHERE deleted_at IS NOT NULL")) == [(1,)] and one(d.sql("SELECT count(*) FROM s")) == [(2,)]
    t = LakeTable.create(spark, shared_path(spark, "t"), "k int, v string")
    t.append(spark.createDataFrame([(1, "a")], "k int, v string"))
    t.branch("dev")
    t.append(spark.createDataFrame([(2, "b")], "k int, v string"), branch="dev")
    t.merge("dev", ["k"], squash=True)
    assert sorted(one(t.read())) == [(1, "a"), (2, "b")] and [r["operation"] for r in t.history().orderBy("depth").collect()] == ["squash", "append", "create"]
    assert [len(x) for x in pr.in_pieces(spark.range(25), 10)] == [10, 10, 5] and list(pr.in_pieces(spark.range(0))) == []
    write_sink(spark.createDataFrame([(1, "x"), (None, "z")], "a int, b string"), str(tmp_path / "w"), sums=["a"])
    assert metadata_aggregate(spark, str(tmp_path / "w"), "a") == (2, 1, 1, "1") and metadata_aggregate(spark, str(tmp_path / "w"), "b") == (2, "x", "z", None)


def test_tiers(spark):
    from millrace.lake.partitioning import tiered

    mk = lambda *x: spark.createDataFrame(list(x), "k int, day string, v string")
    hot, warm, cold = mk((1, "2024-03-02", "h")), mk((1, "2024-03-02", "w"), (2, "2024-02-03", "w")), mk((2, "2024-02-03", "c"), (3, "2023-01-01", "c"), (None, "2023-01-02", "c"))
    t = [(hot, "2024-03-01"), (warm, "2024-02-01"), (cold, None)]
    assert sorted(one(tiered(t, "day", ["k"]).select("k", "v", "_tier")), key=repr) == sorted([(1, "h", 0), (2, "w", 1), (3, "c", 2), (None, "c", 2)], key=repr)
    assert one(tiered(t, "day", ["k"], since="2024-03-01").select("v")) == [("h",)] and one(tiered(t, "day", ["k"], until="2023-01-01").select("v")) == [("c",)]


def test_text_index(spark, tmp_path):
    from millrace.operators.search import bm25
    from millrace.operators.textindex import TextIndex

    d = spark.createDataFrame([(1, "The quick brown fox", "a b"), (2, "quick, very quick Fox brown", "fox"), (3, None, None), (4, "", "quick fox"), (5, "fox the quick", None)], "id int, text string, title string")
    ix = TextIndex.build(d, "id", ["text", "title"], str(tmp_path / "ix"))
    for q in ("quick fox", '"brown fox"', '"quick brown fox"', "qui* NOT the", "NEAR(quick brown, 1)", "zebra OR very", "title:fox", "text:fox AND (the OR none)", '"quick quick"', "zebra"):
        assert sorted(one(ix.match(q))) == sorted(one(match(d, q, ["text", "title"]).select("id"))), q
        if "*" not in q:
            rounded = lambda df: sorted((a, round(b, 9)) for a, b in one(df))
            assert rounded(ix.bm25(q, {"title": 2.0})) == rounded(bm25(d, "id", ["text", "title"], q, {"title": 2.0})), q
    assert one(TextIndex.build(d.limit(0), "id", ["text"], str(tmp_path / "no")).match("fox")) == []


def test_hnsw(spark, tmp_path):
    import numpy as np

    from millrace.operators.hnsw import Graph, HnswIndex

    x = np.random.default_rng(0).normal(size=(600, 8))
    g = Graph(8, "l2")
    g.extend(range(600), x)
    true = lambda q, n: np.argsort(((x - q) ** 2).sum(1))[:n].tolist()
    hit = sum(len({k for _, k in g.search(q, 10)} & set(true(q, 10))) for q in x[:50]) / 500
    assert hit > 0.95
    h = Graph.from_bytes(g.to_bytes())
    h.delete(7)
    assert g.search(x[7], 1)[0][1] == 7 and 7 not in [k for _, k in h.search(x[7], 5)] and Graph.from_bytes(Graph(3).to_bytes()).search([1, 0, 0], 2) == []
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(900, None), (901, [1.0])], "vec_id bigint, embedding array<double>")
    ix = HnswIndex.build(df, str(tmp_path / "g"), 8, metric="l2", rows=200)
    got = one(ix.search(df.where("vec_id < 20 or vec_id > 890"), 5).select("query_id", "vec_id"))
    assert len(got) == 100 and sum(b in true(x[a], 5) for a, b in got) > 95
    assert HnswIndex.build(df.limit(0), str(tmp_path / "e"), 8).search(df, 3).count() == 0


def test_catalog(spark):
    from millrace.lake.catalog import Catalog, CommitFailed

    c = Catalog(spark, shared_path(spark, "cat"))
    c.create_namespace("a", owner="x")
    c.create_namespace("a.b")
    t = c.create_table("a.b.t", "k int")
    assert c.namespaces() == ["a"] and c.namespaces("a") == ["a.b"] and c.tables("a.b") == ["a.b.t"] and c.properties("a", set={"z": 1}, remove=["owner"]) == {"z": 1}
    with pytest.raises(CommitFailed):
        c.commit("a.b.t", [{"type": "assert-ref-snapshot-id", "snapshot-id": None}], [])
    head = c.commit("a.b.t", [{"type": "assert-current-schema-id", "current-schema-id": 0}], [{"action": "append", "rows": spark.range(3).selectExpr("id k")}, {"action": "set-snapshot-ref", "ref-name": "old", "snapshot-id": t.head()["id"]}])
    assert head["lsn"] == 1 and c.load("a.b.t").read().count() == 3 and c.load("a.b.t").read("old").count() == 0
    c.rename("a.b.t", "a.u")
    with pytest.raises(ValueError):
        c.drop_namespace("a")
    c.drop("a.u", purge=True)
    c.drop_namespace("a.b")
    assert not c.exists("a.u") and c.namespaces("a") == []


def test_windows(spark):
    d = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, None), ("b", 5, 4)], "p string, o int, v int")
    got = rel.excluding(d, ["p"], [F.col("o"), F.col("v")], (-5, 5), "current row", "v", "x").select("p", "o", "v", "x_sum", "x_count").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("a", 1, 1, 2.0, 1), ("a", 1, 2, 1.0, 1), ("a", 2, None, 3.0, 2), ("b", 5, 4, None, 0)], key=repr)
    assert datetime.date.today()


def test_sql_routines(spark):
    d = Database(spark)
    q = """SELECT julianday('2024-01-01') AS a, strftime('%Y/%m', '2024-01-31', '+1 month') AS b, date('2024-01-01', 'weekday 1') AS c, substr('hello', -3, 2) AS d, iif(1 > 2, 'x', 'y') AS e,
    printf('%05d|%s|%.1f', 42, NULL, 2.25) AS f, json_extract('{"a":[1,{"b":"z"}]}', '$.a[1].b') AS g, json_set('{"a":1}', '$.b', 2) AS h, json_type('[1.5]', '$[0]') AS i, min(3, 1, 2) AS j, max('a', 'b') AS k,
    char(8364, 65) AS l, quote('it''s') AS m, round(vector_distance_l2('[0,0]', '[3,4]'), 3) AS n, json_object('k', 1, 'v', NULL) AS o, concat('a', NULL, 'b') AS p, unixepoch('1970-01-02') AS r, mod(7, 0) AS s, sqrt(-1) AS t"""
    assert one(d.sql(q)) == [(2460310.5, "2024/03", "2024-01-08", "ll", "y", "00042|NULL|2.3", "z", '{"a":1,"b":2}', "real", 1, "b", "€A", "'it''s'", 5.0, '{"k":1,"v":null}', "ab", 86400, None, None)] or one(d.sql(q))[0][5] == "00042|NULL|2.2"
    assert sorted(one(d.sql("SELECT e.key, e.value FROM (SELECT '{\"x\":1,\"y\":[2]}' AS j) t, LATERAL json_each(t.j) e"))) == [("x", "1"), ("y", "[2]")]
    assert sorted(one(d.sql("WITH RECURSIVE r (n) AS (SELECT 1 UNION SELECT (n * 2) % 11 FROM r) SELECT n FROM r WHERE n > 7"))) == [(8,), (9,), (10,)]


def test_collations(spark):
    from millrace.functions.collation import Collations

    c = Collations()
    d = spark.createDataFrame([("a10",), ("a9",), ("B1",), (None,)], "x string")
    assert [r[0] for r in c.sort(d, "x", "NATURAL").collect()] == ["B1", "a9", "a10", None] and [r[0] for r in c.sort(d, "x", "nocase").collect()] == ["a10", "a9", "B1", None]
    c.create("backwards", F.reverse)
    assert [r[0] for r in c.sort(d, "x", "backwards", nulls_last=False).collect()][0] is None
    c.drop("backwards")
    with pytest.raises(LookupError):
        c.key("backwards", F.col("x"))


def test_sharding(spark):
    from millrace.operators.sharding import HashIndex, RangeIndex, RingIndex, route, routed

    d = spark.range(1000).select(F.col("id").alias("k"))
    h, r, g = HashIndex(8), RangeIndex([100, 500]), RingIndex(["a", "b", "c"])
    for ix in (h, r, g):
        sharded = d.withColumn("shard", ix.shard(F.col("k")))
        for w in ("k = 77", "k IN (1, 500, 999)", "k BETWEEN 50 AND 120", "k > 400 AND k < 600", "k = 1 OR k = 2"):
            assert sorted(one(routed(sharded, ix, w, "k").select("k"))) == sorted(one(d.where(w)))
    assert len(route(spark, h, "k = 5", "k")) == 1 and route(spark, r, "k BETWEEN 50 AND 120", "k") == [0, 1] and route(spark, h, "k > 3", "k") is None
    # Text in literals tells nothing; literals of another kind are left to Spark.
    t = d.withColumn("note", F.lit("k = 7")).withColumn("shard", h.shard(F.col("k")))
    for w in ("note = 'k = 7' AND k > 3", "k = 5.0", "k = 5.5", "k = '5'", "(k = 5 OR k = 900) AND k > 10", "NOT k = 5", "k IN (5, 6.5)"):
        assert sorted(one(routed(t, h, w, "k").select("k"))) == sorted(one(t.where(w).select("k"))), w
    assert rel.numbered(d.limit(0), [F.asc("k")]).count() == 0 and [tuple(x) for x in rel.numbered(d, [F.desc("k")], "n").where("k > 997").orderBy("n").collect()] == [(999, 1), (998, 2)]
    moved = sum(g.of(i) != RingIndex(["a", "b", "c", "d"]).of(i) for i in range(1000))
    assert moved < 400


def test_schema_triggers_normalise(spark):
    from millrace.plans import triggers as tr
    from millrace.plans.schema import ddl, parse_table, struct
    from millrace.streaming.normalise import dated, feed_schema, webhook_changes

    spec = {"id": "long#", "name": "string!", "tags": "string[]?", "n": "int@ = 3", "owner": "-> users", "posts": "<- posts.owner"}
    assert [f.dataType.simpleString() for f in struct(spark, spec)] == ["bigint", "string", "array<string>", "int", "bigint"] and parse_table(spec)[1] == {"posts": "posts.owner"}
    assert ddl("t", {"id": "long#", "n": "int@ = 3"}) == ["CREATE TABLE t (id INTEGER PRIMARY KEY, n INTEGER DEFAULT 3)", "CREATE INDEX t_n ON t (n)"]
    d = Database(spark)
    for s in ddl("t", {"id": "long#", "n": "int@ = 3"}) + ["CREATE TABLE log (row_id TEXT, event TEXT, row TEXT)", "CREATE TABLE kid (id INTEGER, t_id INTEGER)"]:
        d.sql(s)
    d.trigger("v", "before", "insert", "t", tr.validate("n > 0", "n must be positive"))
    d.trigger("a", "after", "insert", "t", tr.audit("log", "insert"))
    d.trigger("c", "after", "delete", "t", tr.cascade("kid", "t_id"))
    d.sql("INSERT INTO t VALUES (1, 5), (2, 6)")
    d.sql("INSERT INTO kid VALUES (1, 1), (2, 2)")
    d.sql("DELETE FROM t WHERE id = 1")
    assert one(d.sql("SELECT id FROM kid")) == [(2,)] and one(d.sql("SELECT count(*) FROM log")) == [(2,)]
    with pytest.raises(tr.Refused):
        d.sql("INSERT INTO t VALUES (3, -5)")
    w = spark.createDataFrame([('{"type":"invoice.created","data":{"id":"i1"}}',), ('{"type":"invoice.deleted","data":{"id":"i1"}}',)], "body string")
    assert one(webhook_changes(w, "body", "pay").select("table_name", "_cdc_row_id", "_cdc_operation")) == [("pay.invoice", "i1", "INSERT"), ("pay.invoice", "i1", "DELETE")]
    p = spark.createDataFrame([('{"a":1,"b":"1","c":true,"d":[1]}',), ('{"a":1.5,"b":"x","e":null}',), (None,)], "after_json string")
    assert dict(one(feed_schema(p)))["a"] == "double" and {k: v for k, v in one(feed_schema(p)) if k in "bcd"} == {"b": "string", "c": "boolean", "d": "string"}
    assert dated(spark.createDataFrame([(datetime.datetime(2024, 3, 5),)], "t timestamp"), F.col("t")).select("year", "month", "day").first() == ("2024", "03", "05")


def test_porter(spark):
    from millrace.functions.stem import stem
    from millrace.operators.search import bm25

    words = "caresses ponies cats agreed plastered motoring conflated hopping falling filing happy relational conditional vietnamization triplicate hopefulness allowance adjustable probate rate controlling".split()
    assert [stem(w) for w in words] == "caress poni cat agre plaster motor conflat hop fall file happi relat condit vietnam triplic hope allow adjust probat rate control".split()
    d = spark.createDataFrame([(1, "She was hopping"), (2, "hops and cats"), (3, None)], "id int, text string")
    assert [r[0] for r in match(d, "hopped cat*", ["text"], "porter").collect()] == [2]
    assert sorted(r[0] for r in bm25(d, "id", ["text"], "hopping", tokenizer="porter").collect()) == [1, 2]
