"""Queries of sources, lake tables, time travel, changes, constraints, change logs, streams, text and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lake import partitioning as pt
from ..lake.catalog import Catalog
from ..lake.tables import Conflict, LakeTable
from ..operators.hnsw import HnswIndex
from ..operators.search import IvfIndex, bm25, highlight, highlight_phrases, knn, knn_join, match, postings, snippet, tfidf
from ..operators.relational import three_way_merge
from ..operators.sharding import FnvIndex, HashIndex, ListIndex, RangeIndex, RingIndex, routed
from ..operators.textindex import TextIndex
from ..plans.database import Database, orphans
from ..session import load, shared_path, ship
from ..sources.readers import detect_format, ingest, metadata_aggregate, read_source, resolve, write_sink
from ..streaming import changelog as cl
from ..streaming.wal import Log, Push

QUERIES: dict = {}
SQL: dict[str, str] = {}
c, lit = F.col, F.lit


def op(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


# Sources and sinks

_CUST = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def _roundtrip(fmt: str, schema: str | None = None):
    def f(s, d):
        at = shared_path(s, fmt)
        write_sink(load(s, d, "customer"), at, fmt)
        return read_source(s, at, fmt, schema).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")

    return f


for _f in ("csv", "tsv", "ndjson", "parquet", "orc"):
    op(f"src_{_f}_roundtrip", _CUST)(_roundtrip(_f))


@op("src_json_array", "SELECT n_nationkey, n_name FROM nation")
def _(s, d):
    at = shared_path(s, "json")
    load(s, d, "nation").agg(F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value")).write.text(at)  # 25 rows
    return read_source(s, at, "json").select("n_nationkey", "n_name")


@op("src_parquet_partitioned", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS t FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderstatus")
def _(s, d):
    at = shared_path(s, "parts")
    pt.write_partitioned(load(s, d, "orders"), at, ["o_orderstatus"])
    return s.read.parquet(at).where("o_orderstatus in ('F', 'O')").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("t"))


@op("src_url_in_sql", "SELECT r_name, r_regionkey FROM region WHERE r_regionkey > 1")
def _(s, d):
    at = shared_path(s, "url")
    write_sink(load(s, d, "region"), at, "csv")
    return Database(s).sql(f"SELECT r_name, r_regionkey FROM url('{at}', 'CSV') WITH (header = 'true', delimiter = ',') WHERE r_regionkey > 1")


@op("src_bloom_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def _(s, d):
    at = shared_path(s, "bloom")
    write_sink(load(s, d, "orders"), at, bloom=["o_custkey"])
    return s.read.parquet(at).where("o_custkey = 7").select("o_orderkey", "o_totalprice")


@op("src_metadata_aggregate", "SELECT count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi, CAST(sum(o_orderkey) AS VARCHAR) AS total FROM orders")
def _(s, d):
    at = shared_path(s, "footers")
    write_sink(load(s, d, "orders"), at, sums=["o_orderkey"])
    return s.createDataFrame([metadata_aggregate(s, at, "o_orderkey")], "n bigint, lo bigint, hi bigint, total string")


@op("src_ingest_sized", "SELECT o_orderkey, 1 AS files FROM orders WHERE o_orderstatus = 'F'")
def _(s, d):
    """Many small pieces become files of the size asked for (here all fit one)."""
    at = shared_path(s, "ingest")
    n = ingest(load(s, d, "orders").repartition(40), at, max_bytes=1 << 30)
    return s.read.parquet(at).where("o_orderstatus = 'F'").select("o_orderkey").withColumn("files", lit(n))


@op("src_detect_format", """SELECT * FROM (VALUES ('a.csv.gz', 'csv'), ('b.parquet', 'parquet'), ('c?x=1', 'text'), ('d.ndjson', 'ndjson'), ('e.tsv', 'tsv')) t(name, format)""")
def _(s, d):
    return s.createDataFrame([(n, detect_format(n).format) for n in ("a.csv.gz", "b.parquet", "c?x=1", "d.ndjson", "e.tsv")], "name string, format string")


@op("src_uri_schemes", "SELECT r_regionkey, r_name FROM region")
def _(s, d):
    """A scheme of one's own, resolved to where it lives."""
    at = shared_path(s, "root")
    write_sink(load(s, d, "region"), f"{at}/tables/region")
    return read_source(s, resolve("r2://tables/region", {"r2": at}), "parquet").select("r_regionkey", "r_name")


# Partition transforms

op("part_year_month_day_hour", "SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(year(ts) * 12 + month(ts) - 1 AS INTEGER) AS m, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS d, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS h, strftime(ts, '%Y-%m') AS t FROM events")(
    lambda s, d: load(s, d, "events").select("event_id", pt.year(c("ts")).alias("y"), pt.month(c("ts")).alias("m"), pt.day(c("ts")).alias("d"), pt.hour(c("ts")).alias("h"), pt.month_text(c("ts")).alias("t")))
op("part_bucket", """SELECT n_nationkey, CAST(abs(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(n_name, ''), lambda ch: CAST(unicode(ch) AS BIGINT))),
lambda a, ch: ((a * 31 + ch + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)) % 16 AS BIGINT) AS b FROM nation""")(lambda s, d: load(s, d, "nation").select("n_nationkey", pt.bucket(c("n_name"), 16).alias("b")))
op("part_truncate", "SELECT c_custkey, left(c_name, 4) AS p, CAST(c_custkey // 10 * 10 AS BIGINT) AS t FROM customer")(lambda s, d: load(s, d, "customer").select("c_custkey", pt.truncate(c("c_name"), 4).alias("p"), pt.truncate(c("c_custkey"), 10, "number").alias("t")))
op("part_path", "SELECT doc_id, 'lang=' || coalesce(lang, '__HIVE_DEFAULT_PARTITION__') || '/source=' || source AS p FROM documents")(lambda s, d: load(s, d, "documents").select("doc_id", pt.path(lang=c("lang"), source=c("source")).alias("p")))


@op("part_prune", "SELECT count(*) AS n FROM events WHERE strftime(ts, '%Y-%m-%d') = (SELECT min(strftime(ts, '%Y-%m-%d')) FROM events)")
def _(s, d):
    at = shared_path(s, "days")
    e = load(s, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    pt.write_partitioned(e, at, ["day"])
    first = e.agg(F.min("day")).first()[0]
    return s.read.option("inferSchema", False).parquet(at).where(F.col("day").cast("string") == first).agg(F.count("*").alias("n"))


# Lake tables


def _versions(s, d) -> LakeTable:
    """Customers in four versions: half, all, an update of some, some deleted."""
    cust = load(s, d, "customer").select("c_custkey", "c_acctbal")
    t = LakeTable.create(s, shared_path(s, "lake"), cust.schema)
    t.append(cust.where("c_acctbal < 4000"))
    t.append(cust.where("c_acctbal >= 4000"))
    t.overwrite(cust.withColumn("c_acctbal", F.expr("if(c_acctbal < 500, c_acctbal + 100, c_acctbal)")))
    t.overwrite(t.read().where("c_acctbal < 9000"), operation="delete")
    return t


op("snapshot_as_of", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 4000")(lambda s, d: _versions(s, d).read(version=1))
op("snapshot_latest", "SELECT c_custkey, CASE WHEN c_acctbal < 500 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_acctbal < 9000")(lambda s, d: _versions(s, d).read())
op("snapshot_list", "SELECT * FROM (VALUES (0, 'create', 0), (1, 'append', 1), (2, 'append', 2), (3, 'overwrite', 1), (4, 'delete', 1)) t(sequence_number, operation, directories)")(lambda s, d: _versions(s, d).snapshots().select("sequence_number", "operation", "directories"))


@op("snapshot_range", "SELECT v AS _version, count(*) AS n FROM customer, (VALUES (2), (3)) x(v) GROUP BY v")
def _(s, d):
    t = _versions(s, d)
    at = {v["lsn"]: v["at"] for v in t.log()}
    return t.between(at[2], at[3]).groupBy("_version").agg(F.count("*").alias("n"))


@op("catalog_commit", "SELECT c_custkey, c_acctbal, 'lake.raw.cust' AS t FROM customer")
def _(s, d):
    """Namespaces, a table, a commit that holds its requirements and one that doesn't, found again by another catalog."""
    cust, at = load(s, d, "customer").select("c_custkey", "c_acctbal"), shared_path(s, "catalog")
    cat = Catalog(s, at)
    cat.create_namespace("lake", owner="me")
    cat.create_namespace("lake.raw")
    first = cat.create_table("lake.raw.cust", cust.schema).head()["id"]
    want = [{"type": "assert-ref-snapshot-id", "ref": "main", "snapshot-id": first}]
    cat.commit("lake.raw.cust", want, [{"action": "append", "rows": cust}, {"action": "set-properties", "updates": {"a": "b"}}])
    try:
        cat.commit("lake.raw.cust", want, [{"action": "append", "rows": cust}])
    except Conflict:
        pass
    again = Catalog(s, at)
    return again.load(again.tables("lake.raw")[0]).read().withColumn("t", lit(again.tables("lake.raw")[0]))


@op("version_diff", "SELECT c_custkey, CASE WHEN c_acctbal >= 9000 THEN 'DELETE' ELSE 'UPDATE' END AS _change_type FROM customer WHERE c_acctbal >= 9000 OR c_acctbal < 500")
def _(s, d):
    return _versions(s, d).diff(2, 4, ["c_custkey"]).select("c_custkey", "_change_type")


@op("rollback", "SELECT c_custkey, c_acctbal FROM customer")
def _(s, d):
    t = _versions(s, d)
    t.rollback(2)
    return t.read()


@op("lake_compaction_same_rows", "SELECT c_custkey, c_acctbal FROM customer")
def _(s, d):
    t = _versions(s, d)
    t.rollback(2)
    t.compact(["c_custkey"])
    return t.read()


@op("lake_schema_evolution", "SELECT c_custkey, c_acctbal AS balance, CAST(CASE WHEN c_acctbal < 4000 THEN NULL ELSE 'x' END AS VARCHAR) AS note FROM customer")
def _(s, d):
    cust = load(s, d, "customer").select("c_custkey", "c_acctbal")
    t = LakeTable.create(s, shared_path(s, "lake"), cust.schema)
    t.append(cust.where("c_acctbal < 4000"))
    t.alter(rename={"c_acctbal": "balance"}, add={"note": "string"})
    t.append(cust.where("c_acctbal >= 4000").select("c_custkey", c("c_acctbal").alias("balance"), lit("x").alias("note")))
    return t.read()


@op("branch_merge_rows", "SELECT c_custkey, CASE WHEN c_acctbal < 2000 THEN c_acctbal + 1 WHEN c_acctbal < 5000 THEN c_acctbal + 2 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_acctbal < 8000")
def _(s, d):
    cust = load(s, d, "customer").select("c_custkey", "c_acctbal")
    t = LakeTable.create(s, shared_path(s, "lake"), cust.schema)
    t.append(cust)
    t.branch("dev")
    t.overwrite(cust.withColumn("c_acctbal", F.expr("if(c_acctbal < 2000, c_acctbal + 1, c_acctbal)")))
    t.overwrite(cust.where("c_acctbal < 8000").withColumn("c_acctbal", F.expr("if(c_acctbal >= 2000 and c_acctbal < 5000, c_acctbal + 2, c_acctbal)")), branch="dev")
    t.merge("dev", ["c_custkey"])
    return t.read()


@op("branch_conflicts", "SELECT count(*) FILTER (WHERE c_acctbal BETWEEN 2000 AND 5000) AS conflicts, count(*) FILTER (WHERE c_acctbal < 2000) AS ours, count(*) FILTER (WHERE c_acctbal > 5000) AS theirs FROM customer")
def _(s, d):
    base = load(s, d, "customer").select("c_custkey", "c_acctbal")
    ours = base.withColumn("c_acctbal", F.expr("if(c_acctbal <= 5000, c_acctbal + 1, c_acctbal)"))
    theirs = base.withColumn("c_acctbal", F.expr("if(c_acctbal >= 2000, c_acctbal + 2, c_acctbal)"))
    return three_way_merge(base, ours, theirs, ["c_custkey"]).agg(*[F.count(F.when(c("_side") == k, 1)).alias(n) for k, n in (("conflict", "conflicts"), ("ours", "ours"), ("theirs", "theirs"))])


# Changes and definitions in SQL


def _db(s, d, *tables: str) -> Database:
    db = Database(s)
    for t in tables:
        db.add_source(t, load(s, d, t))
    return db


def _customers(s, d) -> Database:
    db = _db(s, d, "customer", "nation")
    db.sql("CREATE TABLE cust (id INTEGER PRIMARY KEY, name TEXT NOT NULL, nation INTEGER, bal REAL DEFAULT 0, seg TEXT, CHECK (id >= 0))")
    db.sql("INSERT INTO cust SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
    return db


@op("dml_insert_select", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal FROM customer")
def _(s, d):
    return _customers(s, d).sql("SELECT id, name, bal FROM cust")


# Of the changed rows a fifth has keys that aren't there yet.
_KEY = "CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey + 10000000 ELSE c_custkey END"
_NEW = "UNION ALL SELECT c_custkey + 10000000, {} FROM customer WHERE c_mktsegment = 'BUILDING'"


@op("dml_upsert", "SELECT c_custkey AS id, CASE WHEN c_mktsegment <> 'BUILDING' AND c_nationkey > 12 THEN c_acctbal + 1 ELSE c_acctbal END AS bal FROM customer " + _NEW.format("1.0"))
def _(s, d):
    db = _customers(s, d)
    db.sql(f"INSERT INTO cust (id, name, bal) SELECT {_KEY}, c_name, 1.0 FROM customer WHERE TRUE ON CONFLICT (id) DO UPDATE SET bal = bal + excluded.bal WHERE nation > 12")
    return db.sql("SELECT id, bal FROM cust")


@op("dml_insert_or_ignore", "SELECT c_custkey AS id, c_acctbal AS bal FROM customer " + _NEW.format("5.0"))
def _(s, d):
    db = _customers(s, d)
    db.sql(f"INSERT OR IGNORE INTO cust (id, name, bal) SELECT {_KEY}, c_name, 5.0 FROM customer")
    return db.sql("SELECT id, bal FROM cust")


@op("dml_replace", "SELECT c_custkey AS id, CASE WHEN c_mktsegment <> 'BUILDING' THEN 7.0 ELSE c_acctbal END AS bal FROM customer " + _NEW.format("7.0"))
def _(s, d):
    db = _customers(s, d)
    db.sql(f"REPLACE INTO cust (id, name, bal) SELECT {_KEY}, c_name, 7.0 FROM customer")
    return db.sql("SELECT id, bal FROM cust")


@op("dml_update_returning", "SELECT c_custkey AS id, c_acctbal * 2 AS bal FROM customer WHERE c_mktsegment = 'MACHINERY'")
def _(s, d):
    return _customers(s, d).sql("UPDATE cust SET bal = bal * 2 WHERE seg = 'MACHINERY' RETURNING id, bal")


@op("dml_update_from", "SELECT c_custkey AS id, n_name AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(s, d):
    db = _customers(s, d)
    db.sql("UPDATE cust SET seg = n.n_name FROM nation n WHERE cust.nation = n.n_nationkey")
    return db.sql("SELECT id, seg FROM cust")


@op("dml_delete", "SELECT c_custkey AS id FROM customer WHERE NOT (c_acctbal < 0)")
def _(s, d):
    db = _customers(s, d)
    db.sql("DELETE FROM cust WHERE bal < 0")
    return db.sql("SELECT id FROM cust")


@op("dml_delete_limit_returning", "SELECT c_custkey AS id FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def _(s, d):
    return _customers(s, d).sql("DELETE FROM cust WHERE TRUE ORDER BY bal DESC, id LIMIT 10 RETURNING id")


@op("ddl_alter", "SELECT c_custkey AS id, c_acctbal AS balance, 'new' AS tag FROM customer")
def _(s, d):
    db = _customers(s, d)
    db.sql("ALTER TABLE cust RENAME COLUMN bal TO balance")
    db.sql("ALTER TABLE cust ADD COLUMN tag TEXT DEFAULT 'new'")
    db.sql("ALTER TABLE cust DROP COLUMN seg")
    return db.sql("SELECT id, balance, tag FROM cust")


@op("ddl_transaction_rollback", "SELECT count(*) AS n FROM customer")
def _(s, d):
    db = _customers(s, d)
    db.sql("BEGIN")
    db.sql("DELETE FROM cust")
    db.sql("ROLLBACK")
    return db.sql("SELECT count(*) AS n FROM cust")


@op("time_travel_sql", "SELECT count(*) AS now, (SELECT count(*) FROM customer) AS before FROM customer WHERE c_nationkey <> 3")
def _(s, d):
    db = _customers(s, d)
    db.sql("DELETE FROM cust WHERE nation = 3")
    return db.sql("SELECT (SELECT count(*) FROM cust) AS now, (SELECT count(*) FROM cust AS OF VERSION 1) AS before")


@op("view_expand", "SELECT seg, count(*) AS n FROM (SELECT c_mktsegment AS seg FROM customer WHERE c_acctbal > 0) GROUP BY seg")
def _(s, d):
    db = _customers(s, d)
    db.sql("CREATE VIEW rich AS SELECT * FROM cust WHERE bal > 0")
    return db.sql("SELECT seg, count(*) AS n FROM rich GROUP BY seg")


@op("pragma_table_info", "SELECT * FROM (VALUES (0, 'id', 'bigint', 0, 1), (1, 'name', 'string', 1, 0), (2, 'nation', 'bigint', 0, 0), (3, 'bal', 'double', 0, 0), (4, 'seg', 'string', 0, 0)) t(cid, name, type, notnull, pk)".replace("notnull", '"notnull"'))
def _(s, d):
    return _customers(s, d).sql("PRAGMA table_info('cust')".replace("'", "")).select("cid", "name", "type", "notnull", "pk")


@op("chk_unique", "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def _(s, d):
    return Database.duplicates(load(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@op("chk_fk_orphans", "SELECT doc_id, annotator FROM review_labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.rating > 2) AND doc_id IS NOT NULL")
def _(s, d):
    return orphans(load(s, d, "review_labels"), load(s, d, "documents").where("rating > 2"), ["doc_id"], ["doc_id"]).select("doc_id", "annotator")


@op("chk_check", "SELECT doc_id, rating FROM documents WHERE NOT (rating BETWEEN 1 AND 5)")
def _(s, d):
    return load(s, d, "documents").where("not (rating between 1 and 5)").select("doc_id", "rating")


@op("attach_query", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _(s, d):
    db, other = _customers(s, d), _db(s, d, "nation")
    db.attach("geo", other)
    return db.sql("SELECT n.n_name, count(*) AS n FROM main.cust JOIN geo.nation n ON nation = n.n_nationkey GROUP BY n.n_name")


@op("dml_trigger_audit", "SELECT c_custkey AS id, c_acctbal AS old, c_acctbal * 2 AS new FROM customer WHERE c_acctbal > 0")
def _(s, d):
    db = _customers(s, d)
    db.sql("CREATE TABLE log (id INTEGER, old REAL, new REAL)")
    db.sql("CREATE TRIGGER up AFTER UPDATE OF bal ON cust WHEN NEW.bal > OLD.bal BEGIN INSERT INTO log VALUES (NEW.id, OLD.bal, NEW.bal); END")
    db.sql("UPDATE cust SET bal = bal * 2")
    return db.sql("SELECT id, old, new FROM log")


@op("dml_trigger_ignore", "SELECT c_custkey AS id FROM customer WHERE c_nationkey < 5")
def _(s, d):
    db = _customers(s, d)
    db.sql("CREATE TRIGGER keep BEFORE DELETE ON cust BEGIN SELECT RAISE(IGNORE) WHERE OLD.nation < 5; END")
    db.sql("DELETE FROM cust")
    return db.sql("SELECT id FROM cust")


@op("view_instead_of", "SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS bal FROM customer")
def _(s, d):
    db = _customers(s, d)
    db.sql("CREATE VIEW poor AS SELECT id, bal FROM cust WHERE bal < 0")
    db.sql("CREATE TRIGGER lift INSTEAD OF DELETE ON poor BEGIN UPDATE cust SET bal = 0 WHERE id = OLD.id; END")
    db.sql("DELETE FROM poor")
    return db.sql("SELECT id, bal FROM cust")


@op("fk_cascade", "SELECT n_nationkey AS id FROM nation WHERE n_regionkey <> 1")
def _(s, d):
    db = _db(s, d, "nation", "region")
    db.sql("CREATE TABLE r (id INTEGER PRIMARY KEY)")
    db.sql("CREATE TABLE n (id INTEGER PRIMARY KEY, r INTEGER REFERENCES r(id) ON DELETE CASCADE)")
    db.sql("INSERT INTO r SELECT r_regionkey FROM region")
    db.sql("INSERT INTO n SELECT n_nationkey, n_regionkey FROM nation")
    db.sql("DELETE FROM r WHERE id = 1")
    return db.sql("SELECT id FROM n")


@op("view_materialized", "SELECT c_nationkey AS nation, count(*) AS n FROM customer WHERE c_acctbal >= 0 GROUP BY c_nationkey")
def _(s, d):
    db = _customers(s, d)
    db.sql("CREATE MATERIALIZED VIEW per AS SELECT nation, count(*) AS n FROM cust GROUP BY nation")
    db.sql("DELETE FROM cust WHERE bal < 0")
    db.sql("REFRESH MATERIALIZED VIEW per")
    return db.sql("SELECT nation, n FROM per")


@op("ddl_transaction_isolation", "SELECT count(*) AS n, count(*) FILTER (WHERE c_acctbal >= 0) AS inside, count(*) FILTER (WHERE c_acctbal >= 0) AS later FROM customer")
def _(s, d):
    """What another session counts during a transaction, what the transaction counts, and what the other counts after COMMIT."""
    db = _customers(s, d)
    other, count = Database(s, db.path), lambda x: x.sql("SELECT count(*) FROM cust").first()[0]
    db.sql("BEGIN")
    db.sql("DELETE FROM cust WHERE bal < 0")
    seen = [count(other), count(db)]
    db.sql("COMMIT")
    return s.createDataFrame([(*seen, count(other))], "n bigint, inside bigint, later bigint")


@op("db_reopened", "SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0")
def _(s, d):
    """Tables and views are found by the next database on the path."""
    db = _customers(s, d)
    db.sql("CREATE VIEW poor AS SELECT id FROM cust WHERE bal < 0")
    return Database(s, db.path).sql("SELECT id FROM poor")


@op("db_read_only", "SELECT count(*) AS n, 1 AS refused FROM customer")
def _(s, d):
    db = Database(s, _customers(s, d).path, read_only=True)
    try:
        db.sql("DELETE FROM cust")
        refused = 0
    except PermissionError:
        refused = 1
    return db.sql("SELECT count(*) AS n FROM cust").withColumn("refused", lit(refused))


@op("explain_formats", "SELECT * FROM (VALUES ('ANALYZE FORMAT TREE'), ('FORMAT JSON'), ('FORMAT YAML'), ('QUERY PLAN')) t(how)")
def _(s, d):
    """The formats of EXPLAIN that name the scan."""
    db = _customers(s, d)
    told = {h: "\n".join(r["detail"] for r in db.sql(f"EXPLAIN {h} SELECT seg, count(*) FROM cust GROUP BY seg").collect()) for h in ("QUERY PLAN", "FORMAT JSON", "FORMAT YAML", "ANALYZE FORMAT TREE")}
    return s.createDataFrame([(h,) for h, t in told.items() if "parquet" in t.lower()], "how string")


@op("trigger_builders", "SELECT c_custkey AS id, upper(c_name) AS name, c_acctbal * 2 AS twice FROM customer WHERE c_acctbal >= 0")
def _(s, d):
    from ..plans import triggers as tr

    db = _db(s, d, "customer")
    db.sql("CREATE TABLE c (id INTEGER PRIMARY KEY, name TEXT, bal REAL, twice REAL)")
    for i, f in enumerate((tr.validate("bal >= 0", "in debt"), tr.transform(name=F.upper("name")), tr.computed("twice", "bal * 2"))):
        db.trigger(f"t{i}", "before", "insert", "c", f)
    db.sql("INSERT INTO c (id, name, bal) SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 0")
    return db.sql("SELECT id, name, twice FROM c")


# Functions of one's own


@op("udf_scalar", "SELECT p_partkey, p_size * 2 + 1 AS v FROM part")
def _(s, d):
    db = _db(s, d, "part")
    db.function("twice_plus", lambda x: x * 2 + 1, "bigint", 1)
    return db.sql("SELECT p_partkey, twice_plus(p_size) AS v FROM part")


@op("udaf_custom", "SELECT p_brand, CAST(max(p_size) - min(p_size) AS BIGINT) AS spread FROM part GROUP BY p_brand")
def _(s, d):
    db = _db(s, d, "part")
    db.aggregate("spread_of", lambda x: int(x.max() - x.min()), "bigint")
    return db.sql("SELECT p_brand, spread_of(p_size) AS spread FROM part GROUP BY p_brand")


@op("udtf_custom", "SELECT n_nationkey, unnest(range(1, n_regionkey + 1)) AS i FROM nation WHERE n_regionkey > 0")
def _(s, d):
    from pyspark.sql.functions import udtf

    class Upto:
        def eval(self, n: int):
            for i in range(1, (n or 0) + 1):
                yield (i,)

    s.udtf.register("upto", udtf(Upto, returnType="i bigint"))
    load(s, d, "nation").createOrReplaceTempView("mr_nation")
    return s.sql("SELECT n_nationkey, t.i FROM mr_nation, LATERAL upto(n_regionkey) t")


@op("procedure_call", "SELECT c_custkey FROM customer WHERE c_nationkey = 5")
def _(s, d):
    db = _customers(s, d)
    db.procedure("of_nation", lambda base, n: base.sql("SELECT id AS c_custkey FROM cust WHERE nation = ?", [n]))
    return db.sql("CALL of_nation(5)")


# Change logs and streams

_OP = "CASE lower(left(trim(_cdc_operation), 1)) WHEN 'i' THEN 'insert' WHEN 'c' THEN 'insert' WHEN 'u' THEN 'update' ELSE 'delete' END"


@op("cdc_latest_state", f"SELECT table_name, count(*) AS n FROM (SELECT table_name, _cdc_row_id FROM cdc_events GROUP BY table_name, _cdc_row_id HAVING arg_max({_OP}, _cdc_sequence) <> 'delete') GROUP BY table_name")
def _(s, d):
    return cl.latest_state(load(s, d, "cdc_events"), ["table_name", "_cdc_row_id"]).groupBy("table_name").agg(F.count("*").alias("n"))


@op("cdc_filter_ops", f"SELECT delivery_id FROM cdc_events WHERE delivery_id > 10 AND {_OP} IN ('delete', 'update') AND table_name LIKE '%orders'")
def _(s, d):
    log = load(s, d, "cdc_events").select("delivery_id", c("delivery_id").alias("lsn"), cl.operation(c("_cdc_operation")).alias("op"), "table_name")
    return cl.Subscription(10, ops=["delete", "update"], where="table_name like '%orders'").apply(log).select("delivery_id")


@op("cdc_committed_only", "SELECT delivery_id AS lsn FROM cdc_events WHERE batch_no % 3 <> 0")
def _(s, d):
    e = load(s, d, "cdc_events").select(c("delivery_id").alias("lsn"), F.concat_ws("/", "source_do_id", "batch_no").alias("txn"), cl.operation(c("_cdc_operation")).alias("op"), "batch_no")
    ends = e.select(lit(None).cast("bigint").alias("lsn"), "txn", F.when(c("batch_no") % 3 == 0, "ROLLBACK").otherwise("COMMIT").alias("op"), "batch_no").distinct()
    return cl.committed(e.unionByName(ends)).select("lsn")


@op("cdc_dedup", "SELECT min(delivery_id) AS delivery_id FROM cdc_events GROUP BY source_do_id, _cdc_sequence")
def _(s, d):
    return cl.dedup(load(s, d, "cdc_events").select("source_do_id", "_cdc_sequence", "delivery_id"), "source_do_id", "_cdc_sequence", "delivery_id").select("delivery_id")


@op("cdc_dedup_replicas", """SELECT delivery_id FROM (SELECT *, lag(arrived_at) OVER (PARTITION BY source_do_id, _cdc_sequence ORDER BY arrived_at, is_retry) AS p FROM cdc_events)
WHERE NOT (is_retry AND p IS NOT NULL AND epoch_us(arrived_at) - epoch_us(p) <= 3600000000)""")
def _(s, d):
    e = load(s, d, "cdc_events").select("delivery_id", "source_do_id", "_cdc_sequence", "arrived_at", "is_retry")
    return cl.dedup_replicas(e, ["source_do_id", "_cdc_sequence"], "arrived_at", "is_retry", 3600).select("delivery_id")


@op("cdc_global_order", "SELECT delivery_id FROM cdc_events ORDER BY arrived_at, source_do_id, _cdc_sequence, delivery_id LIMIT 100")
def _(s, d):
    return load(s, d, "cdc_events").orderBy(cl.global_lsn(c("arrived_at"), c("source_do_id"), c("_cdc_sequence")), "delivery_id").limit(100).select("delivery_id")


@op("cdc_tier_classify", "SELECT CASE WHEN table_name LIKE '%.orders' THEN 'P0' WHEN is_retry THEN 'P1' WHEN table_name LIKE '%.products' THEN 'P3' ELSE 'P2' END AS tier, count(*) AS n FROM cdc_events GROUP BY ALL")
def _(s, d):
    t = cl.tier([("P0", c("table_name").endswith(".orders")), ("P1", c("is_retry")), ("P3", c("table_name").endswith(".products"))])
    return load(s, d, "cdc_events").groupBy(t.alias("tier")).agg(F.count("*").alias("n"))


@op("cdc_flush_batches", """SELECT source_do_id, max(n) AS largest FROM (SELECT source_do_id, b, count(*) AS n FROM (SELECT source_do_id, (row_number() OVER (PARTITION BY source_do_id ORDER BY delivery_id) - 1) // 100 AS b FROM cdc_events) GROUP BY ALL) GROUP BY source_do_id""")
def _(s, d):
    e = load(s, d, "cdc_events").select("source_do_id", "delivery_id", "arrived_at")
    b = cl.flush_batches(e, "source_do_id", "delivery_id", lit(1), "arrived_at", max_events=100, max_bytes=10**9, max_seconds=10**9)
    return b.groupBy("source_do_id", "batch").count().groupBy("source_do_id").agg(F.max("count").alias("largest"))


@op("cdc_flatten_payload", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS payload_k FROM events")
def _(s, d):
    return cl.flatten_payload(load(s, d, "events").select("event_id", "props"), "props", "k bigint")


@op("cdc_partition_key", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS p FROM events")
def _(s, d):
    return load(s, d, "events").select("event_id", cl.partition_key(c("props"), c("ts")).alias("p"))


@op("stream_equals_batch", SQL["cdc_latest_state"])
def _(s, d):
    from ..lake.upserts import EqualityDeleteTable

    e, key = load(s, d, "cdc_events").select("table_name", "_cdc_row_id", "_cdc_sequence", "_cdc_operation", "after_json"), ["table_name", "_cdc_row_id"]
    log = shared_path(s, "log")
    e.repartition(3).write.parquet(log)
    t = EqualityDeleteTable(s, shared_path(s, "state"), key, ["after_json"])
    cl.stream_to_table(cl.stream_log(s, log, e.schema, max_files=1), t, shared_path(s, "checkpoint")).awaitTermination()
    return t.read().groupBy("table_name").agg(F.count("*").alias("n"))


@op("stream_dedup", "SELECT count(*) AS n FROM (SELECT DISTINCT source_do_id, _cdc_sequence FROM cdc_events)")
def _(s, d):
    e = load(s, d, "cdc_events").select("source_do_id", "_cdc_sequence", c("arrived_at").cast("timestamp").alias("arrived_at"))
    log, out = shared_path(s, "log"), shared_path(s, "out")
    e.write.parquet(log)
    q = cl.stream_dedup(cl.stream_log(s, log, "source_do_id string, _cdc_sequence bigint, arrived_at timestamp"), "source_do_id", "_cdc_sequence", "arrived_at", "3650 days")
    q.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(s, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out).agg(F.count("*").alias("n"))


@op("cdc_slots", "SELECT delivery_id FROM cdc_events WHERE delivery_id > 100 AND table_name LIKE '%orders'")
def _(s, d):
    """What a slot that was acknowledged up to 100 still has to read."""
    slots = cl.Slots(s, shared_path(s, "slots"))
    slots.create("mine", where="table_name like '%orders'")
    slots.acknowledge("mine", 100)
    slots.acknowledge("mine", 50)
    return slots.read("mine", load(s, d, "cdc_events").select("delivery_id", c("delivery_id").alias("lsn"), "table_name")).select("delivery_id")


@op("cdc_decode", f"SELECT delivery_id, {_OP} AS operation, json_extract_string(after_json, '$.id') AS id FROM cdc_events")
def _(s, d):
    return cl.decode(load(s, d, "cdc_events"), "id string").select("delivery_id", "operation", c("data.id").alias("id"))


@op("cdc_hlc_order", "SELECT delivery_id FROM cdc_events ORDER BY arrived_at, delivery_id % 7, source_do_id, delivery_id LIMIT 50")
def _(s, d):
    hlc = F.struct(F.unix_micros(c("arrived_at").cast("timestamp")).alias("physicalTime"), (c("delivery_id") % 7).cast("int").alias("logicalCounter"), c("source_do_id").alias("nodeId"))
    return cl.by_hlc(load(s, d, "cdc_events").select("delivery_id", c("delivery_id").alias("lsn"), lit("INSERT").alias("op"), hlc.alias("hlc"))).limit(50).select("delivery_id")


@op("cdc_webhooks", "SELECT event_id, 'pay.' || event_type AS table_name, CAST(event_id AS VARCHAR) AS row_id FROM events")
def _(s, d):
    from ..streaming.normalise import webhook_changes

    body = F.to_json(F.struct(F.concat("event_type", lit(".created")).alias("type"), F.struct(c("event_id").cast("string").alias("id")).alias("data")))
    return webhook_changes(load(s, d, "events").select("event_id", body.alias("body")), "body", "pay").select("event_id", "table_name", c("_cdc_row_id").alias("row_id"))


_SEEN = "source_do_id IS NOT NULL AND _cdc_sequence IS NOT NULL"


@op("stream_once", f"SELECT min(delivery_id) AS delivery_id FROM cdc_events WHERE {_SEEN} GROUP BY source_do_id, _cdc_sequence")
def _(s, d):
    """Deliveries as a stream, the latest files first, so that most first deliveries come after their copies."""
    from ..lake.dedupe import MessageStore

    e, log = load(s, d, "cdc_events").select("source_do_id", "_cdc_sequence", "delivery_id"), shared_path(s, "log")
    e.repartitionByRange(3, F.desc("delivery_id")).write.parquet(log)
    store = MessageStore(s, shared_path(s, "messages"), ["source_do_id", "_cdc_sequence"], "delivery_id", 8)
    cl.stream_once(cl.stream_log(s, log, e.schema, max_files=1), store, shared_path(s, "checkpoint")).awaitTermination()
    return store.read().select("delivery_id")


@op("wal_tail", "SELECT event_id, user_id FROM events WHERE event_id > (SELECT max(event_id) - 100 FROM events)")
def _(s, d):
    """Events written to a log in two segments; the last hundred numbers."""
    e, log = load(s, d, "events").select("event_id", "user_id"), Log(s, shared_path(s, "wal"))
    cut = e.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    log.append(e.where(c("event_id") <= cut), [F.asc("event_id")])
    log.append(e.where(c("event_id") > cut), [F.asc("event_id")])
    return log.read(log.last() - 100).select("event_id", "user_id")


@op("wal_push", "SELECT event_id FROM events")
def _(s, d):
    """Everything a handler was given that fails once on each batch: each event once."""
    e, log, out = load(s, d, "events").select("event_id"), Log(s, shared_path(s, "wal")), shared_path(s, "pushed")
    log.append(e, [F.asc("event_id")])
    slots, failed = cl.Slots(s, shared_path(s, "slots")), set()
    slots.create("reader")

    def handle(batch, first, last):
        if first not in failed:
            failed.add(first)
            raise OSError("not now")
        batch.select("event_id").write.mode("overwrite").parquet(f"{out}/b{first}")

    Push(log, slots, "reader", handle, size=log.last() // 2 + 1, wait=0.01).run()
    return s.read.parquet(f"{out}/*")


@op("tiers_merge", "SELECT event_id, CASE WHEN ts >= (SELECT max(ts) - INTERVAL 1 DAY FROM events) THEN 0 ELSE 1 END AS tier FROM events")
def _(s, d):
    """Events in a hot tier (the last day) and a cold one that holds all."""
    e = load(s, d, "events").select("event_id", "ts")
    hot = e.where(c("ts") >= lit(e.agg(F.max("ts") - F.expr("interval 1 day")).first()[0]))
    return pt.tiered([(hot, None), (e, None)], "ts", ["event_id"]).select("event_id", c("_tier").alias("tier"))


@op("procedure_steps", "SELECT count(*) AS n, 1 AS refused FROM customer WHERE c_nationkey <> 5")
def _(s, d):
    """A procedure with checked arguments, in a transaction, tried again on a conflict."""
    from ..plans import procedures as pr

    db = _customers(s, d)
    db.procedure("drop_nation", pr.procedure(lambda b, n: b.sql(f"DELETE FROM cust WHERE nation = {n}"), pr.retrying(), pr.validated(int), pr.in_transaction()))
    try:
        db.sql("CALL drop_nation('x')")
        refused = 0
    except pr.InvalidArgument:
        refused = 1
    db.sql("CALL drop_nation(5)")
    return db.sql("SELECT count(*) AS n FROM cust").withColumn("refused", lit(refused))


# Shards


@op("shard_fnv_bucket", """SELECT o_orderkey, CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(CAST(o_orderkey AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) % 4294967296) % 16 AS INTEGER) AS shard FROM orders""")
def _(s, d):
    return load(s, d, "orders").select("o_orderkey", FnvIndex(16).shard(c("o_orderkey")).alias("shard"))


_WHERE = "o_orderkey IN (7, 33, 5.0) AND o_orderpriority <> 'o_orderkey = 1' OR o_custkey < 5"
for _n, _index in (("hash", HashIndex(8)), ("ring", RingIndex(["a", "b", "c"])), ("range", RangeIndex([100, 5000])), ("list", ListIndex([[7, 33], [5]]))):
    for _k, _w in (("point", "o_orderpriority <> 'o_orderkey = 9' AND o_orderkey = 7"), ("few", "o_orderkey IN (7, 33, 5.0) AND o_custkey > 3"), ("all", _WHERE)):

        @op(f"shard_{_n}_{_k}", f"SELECT o_orderkey, o_custkey FROM orders WHERE {_w}")
        def _(s, d, index=_index, w=_w):
            ship(s)
            at = shared_path(s, "shards")
            pt.write_partitioned(load(s, d, "orders").withColumn("shard", index.shard(c("o_orderkey"))), at, ["shard"])
            return routed(s.read.parquet(at), index, w, "o_orderkey").select("o_orderkey", "o_custkey")


@op("branch_history", "SELECT * FROM (VALUES (0, 'create', 3), (1, 'append', 2), (2, 'overwrite', 1), (2, 'append', 1), (3, 'merge', 0)) t(sequence_number, operation, depth)")
def _(s, d):
    cust = load(s, d, "customer").select("c_custkey", "c_acctbal")
    t = LakeTable.create(s, shared_path(s, "lake"), cust.schema)
    t.append(cust)
    t.branch("dev")
    t.overwrite(cust.withColumn("c_acctbal", c("c_acctbal") + 1))
    t.append(cust.select((-c("c_custkey")).alias("c_custkey"), "c_acctbal"), branch="dev")
    t.merge("dev", ["c_custkey"])
    return t.history().select("sequence_number", "operation", "depth")


# Text search: words by letters and digits, in lower case

_W = r"list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: x)"
_DOC = f"(SELECT doc_id, {_W} AS w FROM documents)"


def _find(q: str):
    return lambda s, d: match(load(s, d, "documents"), q, ["text"]).select("doc_id")


op("fts_term", f"SELECT doc_id FROM {_DOC} WHERE list_contains(w, 'kettle')")(_find("kettle"))
op("fts_phrase", f"SELECT doc_id FROM {_DOC} WHERE array_to_string(list_concat([''], list_concat(w, [''])), ' ') LIKE '% after two days %'")(_find('"after two days"'))
op("fts_prefix", f"SELECT doc_id FROM {_DOC} WHERE len(list_filter(w, lambda x: starts_with(x, 'kett'))) > 0")(_find("kett*"))
op("fts_boolean", f"SELECT doc_id FROM {_DOC} WHERE (list_contains(w, 'broke') AND NOT list_contains(w, 'battery')) OR (list_contains(w, 'screen') AND list_contains(w, 'manual'))")(_find("broke NOT battery OR screen AND manual"))
op("fts_near", f"""SELECT DISTINCT doc_id FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM {_DOC}) WHERE (w[i] = 'price' AND list_contains(w[i:i + 5], 'surprisingly')) OR (w[i] = 'surprisingly' AND list_contains(w[i:i + 5], 'price'))""")(_find("NEAR(price surprisingly, 5)"))
op("fts_column", "SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+'), 'love')")(lambda s, d: match(load(s, d, "documents"), "title:love", ["title", "text"]).select("doc_id"))
op("fts_trigram_count", "SELECT count(*) AS n FROM (SELECT unnest(range(1, length(title) - 1)) FROM documents WHERE length(title) >= 3)")(lambda s, d: postings(load(s, d, "documents"), "doc_id", ["title"], "trigram").agg(F.count("*").alias("n")))
op("fts_postings", f"SELECT count(*) AS n, count(DISTINCT t) AS terms FROM (SELECT unnest(w) AS t FROM {_DOC})")(lambda s, d: postings(load(s, d, "documents"), "doc_id", ["text"]).agg(F.count("*").alias("n"), F.count_distinct("term").alias("terms")))
_TF = lambda t: f"len(list_filter(w, lambda x: x = '{t}'))"
op("fts_bm25", f"""WITH f AS (SELECT doc_id, len(w) AS n, {_TF('screen')} AS a, {_TF('manual')} AS b FROM {_DOC}), s AS (SELECT count(*) AS c, avg(n) AS l, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM f)
SELECT doc_id, round(ln((c - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / l)) + ln((c - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / l)), 6) AS score FROM f, s WHERE a > 0 OR b > 0""")(
    lambda s, d: bm25(load(s, d, "documents"), "doc_id", ["text"], "screen OR manual").withColumn("score", F.round("score", 6)))
op("fts_tfidf", f"WITH f AS (SELECT doc_id, len(w) AS n, {_TF('screen')} AS a FROM {_DOC}) SELECT doc_id, round(a / n * ln((SELECT count(*) FROM f) / (SELECT count(*) FROM f WHERE a > 0)), 6) AS score FROM f WHERE a > 0")(
    lambda s, d: tfidf(load(s, d, "documents"), "doc_id", ["text"], "screen").withColumn("score", F.round("score", 6)))
op("fts_highlight", r"SELECT doc_id, regexp_replace(text, '(?i)\b(screen|manual)\b', '<b>\1</b>', 'g') AS h FROM documents")(lambda s, d: load(s, d, "documents").select("doc_id", highlight(c("text"), "screen manual").alias("h")))
op("fts_highlight_phrases", r"SELECT doc_id, regexp_replace(text, '(?i)\b(after[^\p{L}\p{N}]+two[^\p{L}\p{N}]+days|screen)\b', '<b>\1</b>', 'g') AS h FROM documents")(
    lambda s, d: load(s, d, "documents").select("doc_id", highlight_phrases(c("text"), '"after two days" OR screen').alias("h")))
op("fts_snippet")(lambda s, d: match(load(s, d, "documents"), "screen", ["text"]).select("doc_id", snippet(c("text"), "screen").alias("snippet")))

def _index(s, d) -> TextIndex:
    return TextIndex.build(load(s, d, "documents"), "doc_id", ["text"], shared_path(s, "text-index"))


for _n, _of, _q2 in (("term", "fts_term", "kettle"), ("phrase", "fts_phrase", '"after two days"'), ("prefix", "fts_prefix", "kett*"), ("boolean", "fts_boolean", "broke NOT battery OR screen AND manual"), ("near", "fts_near", "NEAR(price surprisingly, 5)")):
    op(f"fts_index_{_n}", SQL[_of])(lambda s, d, q=_q2: _index(s, d).match(q))
op("fts_index_bm25", SQL["fts_bm25"])(lambda s, d: _index(s, d).bm25("screen OR manual").withColumn("score", F.round("score", 6)))

# Vector search

_D = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_KNN = f"WITH v AS (SELECT vec_id, label, {_D} AS e FROM embeddings), q AS (SELECT e AS qe FROM v ORDER BY vec_id LIMIT 1) SELECT vec_id, round({{}}, 6) AS distance FROM v, q {{}} ORDER BY {{}}, vec_id LIMIT 10"


def _q(s, d) -> list[float]:
    return list(load(s, d, "embeddings").orderBy("vec_id").select("embedding").first()[0])


for _m, _e in (("cos", "1 - greatest(-1, least(1, list_cosine_similarity(e, qe)))"), ("l2", "list_distance(e, qe)"), ("dot", "-list_inner_product(e, qe)")):
    op(f"vec_{_m}_topk", _KNN.format(_e, "", _e))(lambda s, d, m=_m: knn(load(s, d, "embeddings"), _q(s, d), 10, m).select("vec_id", F.round("distance", 6).alias("distance")))
op("vec_hybrid", _KNN.format("list_distance(e, qe)", "WHERE label < 5", "list_distance(e, qe)"))(lambda s, d: knn(load(s, d, "embeddings"), _q(s, d), 10, "l2", where="label < 5").select("vec_id", F.round("distance", 6).alias("distance")))


@op("vec_knn_join", f"""WITH v AS (SELECT vec_id, {_D} AS e FROM embeddings), r AS (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - greatest(-1, least(1, list_cosine_similarity(a.e, b.e))), b.vec_id) AS rank FROM v a, v b WHERE a.vec_id % 100 = 0)
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def _(s, d):
    ship(s)
    v = load(s, d, "embeddings")
    return knn_join(v.where("vec_id % 100 = 0"), v, 5).select("query_id", "vec_id", "rank")


def _recall(s, d, search):
    """The share of true neighbours that an approximate index finds, over all queries."""
    ship(s)
    v = load(s, d, "embeddings")
    q = v.where("vec_id % 100 = 0")
    true, got = knn_join(q, v, 10).select("query_id", "vec_id"), search(v, q).select("query_id", "vec_id", lit(1).alias("hit"))
    return true.join(got, ["query_id", "vec_id"], "left").agg(F.round(F.avg(F.coalesce("hit", lit(0))), 4).alias("recall"))


@op("vec_ivf_recall")
def _(s, d):
    return _recall(s, d, lambda v, q: IvfIndex(v).search(q, 10))


def _hnsw(s, v) -> HnswIndex:
    dim = len(v.where("embedding is not null").select("embedding").first()[0])
    return HnswIndex.build(v, shared_path(s, "graphs"), dim)


@op("vec_hnsw_recall", "SELECT TRUE AS found_nine_in_ten")
def _(s, d):
    r = _recall(s, d, lambda v, q: _hnsw(s, v).search(q, 10))
    return r.select((c("recall") >= 0.9).alias("found_nine_in_ten"))
