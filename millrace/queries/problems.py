"""Queries of the general training-data problems, by name, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lake.compaction import current_files, matched, plan_rewrites, rewrite
from ..lake.dedupe import p5_found
from ..lake.drift import p3_found, p3_likely_renames, p3_unified
from ..lake.incremental import p4_committed, p4_found, p4_gaps
from ..lake.upserts import p2_current_payload, p2_found, p2_unplaced
from ..session import load, shared_path


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_rewrites(load(spark, sf_dir, "data_files"), load(spark, sf_dir, "snapshots"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).select("table_name", "file_path")


def p1_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By table: small files, their bytes and records, and how many files they become."""
    p = _plan(spark, sf_dir)
    targets = p.select("table_name", "target_file").distinct().groupBy("table_name").agg(F.count("*").alias("target_files"))
    return p.groupBy("table_name").agg(F.count("*").alias("small_files"), F.sum("size").alias("bytes"), F.sum("records").alias("records")).join(targets, "table_name")


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_files(load(spark, sf_dir, "data_files"), load(spark, sf_dir, "snapshots"))


def p1_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Move the change events of all small files into their target files; by table, whether every planned record is there once."""
    return rewrite(load(spark, sf_dir, "cdc_events"), _plan(spark, sf_dir), ["table_name", "file_path", "delivery_id"], shared_path(spark, "compacted"), _current(spark, sf_dir))


def p1_unmoved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small files p1_rewrite can't move, as not all of their records are among the change events: they must stay."""
    return matched(load(spark, sf_dir, "cdc_events"), _plan(spark, sf_dir), _current(spark, sf_dir)).where("not whole").select("table_name", "file_path", "records", "rows")


QUERIES = {
    "p1_found": p1_found, "p1_targets": p1_targets, "p1_rewrite": p1_rewrite, "p1_unmoved": p1_unmoved, "p2_found": p2_found, "p2_current_payload": p2_current_payload, "p2_unplaced": p2_unplaced,
    "p3_found": p3_found, "p3_unified": p3_unified, "p3_likely_renames": p3_likely_renames, "p4_found": p4_found, "p4_gaps": p4_gaps, "p4_committed": p4_committed, "p5_found": p5_found,
}

_INT = "try_cast(try_cast(replace(replace(trim({0}), ',', ''), '_', '') AS DECIMAL(38,3)) AS BIGINT)"

_SMALL = f"""
WITH f AS (
  SELECT table_name, file_path, max(CASE WHEN status = 1 THEN snapshot_id END) AS snapshot_id,
         max(CASE WHEN status = 1 THEN partition_path END) AS partition_path, max(CASE WHEN status = 1 THEN file_size_in_bytes END) AS known,
         max(CASE WHEN status = 1 THEN record_count END) AS records, max(CASE WHEN status = 2 THEN 1 ELSE 0 END) AS gone
  FROM data_files WHERE table_name IS NOT NULL AND file_path IS NOT NULL
  GROUP BY table_name, file_path HAVING max(CASE WHEN status = 1 THEN 1 ELSE 0 END) = 1),
k AS (SELECT table_name, snapshot_id, coalesce(sum(known), 0) AS known_sum FROM f GROUP BY table_name, snapshot_id HAVING count(*) = count(known) + 1),
s AS (SELECT table_name, snapshot_id, max({_INT.format('added_files_size')}) AS said FROM snapshots GROUP BY table_name, snapshot_id),
sized AS (
  SELECT f.table_name, f.file_path, f.partition_path, f.records, coalesce(f.known, s.said - k.known_sum) AS size
  FROM f LEFT JOIN k ON f.table_name = k.table_name AND f.snapshot_id = k.snapshot_id
         LEFT JOIN s ON f.table_name = s.table_name AND f.snapshot_id = s.snapshot_id WHERE f.gone = 0),
small AS (SELECT *, count(*) OVER (PARTITION BY table_name, partition_path) AS n FROM sized WHERE size < 8388608)
"""

_COVERED = """
e AS (SELECT table_name, run_id, arg_max(lower(trim(status)), logged_at) AS st, any_value(from_snapshot_id) AS f, any_value(to_snapshot_id) AS t
      FROM consumer_runs GROUP BY table_name, run_id),
o AS (SELECT DISTINCT table_name, snapshot_id, sequence_number AS no FROM snapshots),
iv AS (SELECT e.table_name, CASE WHEN e.f IS NULL THEN 0 ELSE a.no END AS lo, b.no AS hi FROM e
       JOIN o b ON b.table_name = e.table_name AND b.snapshot_id = e.t LEFT JOIN o a ON a.table_name = e.table_name AND a.snapshot_id = e.f WHERE e.st = 'succeeded'),
done AS (SELECT DISTINCT o.table_name, o.snapshot_id, o.no FROM o JOIN iv ON iv.table_name = o.table_name AND o.no > iv.lo AND o.no <= iv.hi)
"""

_HOMES = "WITH RECURSIVE" + _SMALL.strip().removeprefix("WITH") + """,
p AS (SELECT * FROM small WHERE n > 1),
gone AS (SELECT d.table_name, d.file_path, max(d.snapshot_id) AS by_snapshot,
         (SELECT max(x.partition_path) FROM data_files x WHERE x.table_name = d.table_name AND x.file_path = d.file_path) AS part FROM data_files d
         WHERE d.status = 2 AND EXISTS (SELECT 1 FROM snapshots s WHERE s.table_name = d.table_name AND s.snapshot_id = d.snapshot_id AND lower(trim(s.operation)) = 'replace')
         GROUP BY d.table_name, d.file_path),
made AS (SELECT table_name, snapshot_id, partition_path, min(file_path) AS into_file FROM data_files WHERE status = 1
         GROUP BY table_name, snapshot_id, partition_path HAVING count(DISTINCT file_path) = 1),
step AS (SELECT g.table_name, g.file_path, m.into_file FROM gone g JOIN made m ON g.table_name = m.table_name AND g.by_snapshot = m.snapshot_id AND g.part IS NOT DISTINCT FROM m.partition_path),
trail AS (SELECT table_name, file_path, into_file FROM step UNION SELECT t.table_name, t.file_path, s.into_file FROM trail t JOIN step s ON s.table_name = t.table_name AND s.file_path = t.into_file),
home AS (SELECT table_name, file_path, file_path AS into_file FROM p UNION SELECT table_name, file_path, into_file FROM trail),
got AS (SELECT h.table_name, h.into_file, count(*) AS n FROM cdc_events e JOIN home h ON h.table_name = e.table_name AND h.file_path = e.file_path GROUP BY h.table_name, h.into_file),
full_plan AS (SELECT p.*, coalesce(got.n, 0) AS rows, coalesce(got.n, 0) IS NOT DISTINCT FROM p.records AS whole,
              concat(coalesce(p.partition_path, '/'), ' ', CAST((sum(p.size) OVER (PARTITION BY p.table_name, p.partition_path ORDER BY p.file_path) - p.size) // 134217728 AS VARCHAR)) AS target
              FROM p LEFT JOIN got ON got.table_name = p.table_name AND got.into_file = p.file_path)
"""

SQL: dict[str, str] = {
    "p1_found": _SMALL + "SELECT table_name, file_path FROM small WHERE n > 1",
    "p1_targets": _SMALL + """, t AS (SELECT *, (sum(size) OVER (PARTITION BY table_name, partition_path ORDER BY file_path) - size) // 134217728 AS no FROM small WHERE n > 1)
SELECT table_name, count(*) AS small_files, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(records) AS BIGINT) AS records, count(DISTINCT concat(coalesce(partition_path, '/'), ' ', CAST(no AS VARCHAR))) AS target_files FROM t GROUP BY table_name""",
    "p1_rewrite": _HOMES + """SELECT table_name, count(*) AS small_files, CAST(sum(records) AS BIGINT) AS records, count(*) FILTER (WHERE NOT whole) AS unmoved_files, CAST(sum(rows) AS BIGINT) AS rows_before,
CAST(coalesce(sum(rows) FILTER (WHERE whole), 0) AS BIGINT) AS rows_after, count(DISTINCT target) FILTER (WHERE whole AND rows > 0) AS target_files, bool_and(whole) AS reconciled FROM full_plan GROUP BY table_name""",
    "p1_unmoved": _HOMES + "SELECT table_name, file_path, records, rows FROM full_plan WHERE NOT whole",
    "p2_found": """
SELECT table_name, _cdc_row_id, max(_cdc_sequence) AS _cdc_sequence FROM cdc_events GROUP BY table_name, _cdc_row_id
HAVING arg_max(lower(left(trim(_cdc_operation), 1)), _cdc_sequence) <> 'd'""",
    "p2_current_payload": """
SELECT table_name, _cdc_row_id, max(_cdc_sequence) AS _cdc_sequence, CAST(len(json_keys(arg_max(after_json, _cdc_sequence))) AS INTEGER) AS n_fields
FROM (SELECT table_name, _cdc_row_id, _cdc_sequence, _cdc_operation, after_json FROM cdc_events) GROUP BY table_name, _cdc_row_id
HAVING arg_max(lower(left(trim(_cdc_operation), 1)), _cdc_sequence) <> 'd'""",
    "p2_unplaced": """
SELECT table_name, count(*) AS deliveries, count(*) FILTER (WHERE table_name IS NULL OR _cdc_row_id IS NULL OR _cdc_sequence IS NULL) AS unplaced FROM cdc_events GROUP BY table_name""",
    "p3_found": """
WITH o AS (SELECT DISTINCT table_name, snapshot_id, sequence_number AS no FROM snapshots WHERE sequence_number IS NOT NULL),
e AS (SELECT c.table_name, o.no, c.before_json, c.after_json FROM cdc_events c JOIN o ON c.table_name = o.table_name AND c.snapshot_id = o.snapshot_id WHERE after_json IS NOT NULL),
steps AS (SELECT table_name, no, lead(no) OVER (PARTITION BY table_name ORDER BY no) AS following, min(no) OVER (PARTITION BY table_name) AS first_no FROM (SELECT DISTINCT table_name, no FROM e)),
f AS (SELECT table_name, no, unnest(json_keys(after_json)) AS field, after_json FROM e),
k AS (SELECT table_name, field, no, CASE json_type(json_extract(after_json, '$."' || field || '"')) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN NULL ELSE 'number' END AS kind FROM f),
life AS (SELECT table_name, field, min(no) AS lo, max(no) AS hi FROM f GROUP BY ALL),
added AS (SELECT DISTINCT l.table_name, l.lo AS moment, l.field FROM life l JOIN steps s ON s.table_name = l.table_name WHERE l.lo > s.first_no),
removed AS (SELECT l.table_name, s.following AS moment, l.field FROM life l JOIN steps s ON s.table_name = l.table_name AND s.no = l.hi WHERE s.following IS NOT NULL),
seen AS (SELECT r.table_name, r.moment, r.field AS old_field, a.field AS new_field, CAST(json_extract(e.before_json, '$."' || r.field || '"') AS VARCHAR) AS x, CAST(json_extract(e.after_json, '$."' || a.field || '"') AS VARCHAR) AS y
         FROM removed r JOIN added a ON a.table_name = r.table_name AND a.moment = r.moment JOIN e ON e.table_name = r.table_name AND e.no >= r.moment AND e.before_json IS NOT NULL
         WHERE list_contains(json_keys(e.before_json), r.field) AND list_contains(json_keys(e.after_json), a.field)),
renamed AS (SELECT table_name, moment, old_field, new_field FROM seen GROUP BY ALL HAVING bool_and(x = y) AND count(*) FILTER (WHERE x <> 'null') > 0),
kinds AS (SELECT table_name, field, kind, min(no) AS lo, max(no) AS hi, count(*) OVER (PARTITION BY table_name, field) AS n FROM k WHERE kind IS NOT NULL GROUP BY table_name, field, kind),
cases AS (
  SELECT table_name, moment, 'renamed' AS change_kind, old_field, new_field FROM renamed
  UNION ALL SELECT table_name, moment, 'added', '', field FROM added x WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.table_name = x.table_name AND r.moment = x.moment AND r.new_field = x.field)
  UNION ALL SELECT table_name, moment, 'removed', field, '' FROM removed x WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.table_name = x.table_name AND r.moment = x.moment AND r.old_field = x.field)
  UNION ALL SELECT a.table_name, b.lo, 'retyped', a.field, a.field FROM kinds a JOIN kinds b ON a.table_name = b.table_name AND a.field = b.field AND a.n = 2 AND a.hi < b.lo)
SELECT c.table_name, o.snapshot_id, change_kind, old_field, new_field FROM cases c JOIN o ON o.table_name = c.table_name AND o.no = c.moment""",
    "p4_found": f"""WITH {_COVERED}
SELECT source_do_id, _cdc_sequence FROM cdc_events c LEFT JOIN done ON done.table_name = c.table_name AND done.snapshot_id = c.snapshot_id
GROUP BY source_do_id, _cdc_sequence HAVING count(done.no) = 0""",
    "p4_gaps": f"""WITH {_COVERED}
SELECT table_name, CAST(count(*) AS BIGINT) AS snapshots_to_read FROM o WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.table_name = o.table_name AND done.no = o.no) GROUP BY table_name""",
    "p5_found": """
WITH RECURSIVE r AS (SELECT delivery_id AS d, session_id || chr(1) || id AS a, nullif(lower(trim(idempotency_key)), '') AS k FROM rpc_requests),
e AS (SELECT DISTINCT x.d AS x, y.d AS y FROM r x JOIN r y ON x.a = y.a UNION SELECT DISTINCT x.d, y.d FROM r x JOIN r y ON x.k = y.k),
reach AS (SELECT d AS n, d AS m FROM r UNION SELECT e.y, reach.m FROM reach JOIN e ON e.x = reach.n WHERE e.y > reach.m OR e.y < reach.n),
low AS (SELECT n, min(m) AS m FROM reach GROUP BY n)
SELECT 'rpc' AS feed, n AS delivery_id FROM low WHERE m < n
UNION ALL
SELECT 'cdc', delivery_id FROM (SELECT delivery_id, min(delivery_id) OVER (PARTITION BY source_do_id, _cdc_sequence) AS m FROM cdc_events) WHERE delivery_id > m""",
}
SQL["p4_committed"] = SQL["p4_found"]
