"""Relational queries: written once in SQL, read by our dialect on Spark and natively by the oracle, or as operators beside SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.relational import (
    as_of_join, excluding, group_concat, groups_frame, json_group_array, json_group_object, merge_sorted, numbered, recursive_distinct, reference_join, top_n, total, version_diff,
)
from ..operators.sharding import bucketed_join
from ..plans.dialect import bind, translate
from ..session import load, register_views

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def run(spark: SparkSession, sf_dir: str, sql: str, params=None, **how) -> DataFrame:
    """A query in our dialect over the tables of a directory."""
    text, names = translate(sql, **how)
    register_views(spark, sf_dir, [t for t in BASE if t in sql])
    return spark.sql(text, args=bind(names, params)) if names else spark.sql(text)


def both(name: str, sql: str, oracle: str | None = None, params=None) -> None:
    """A query whose SQL the oracle reads as it is, or in its own words."""
    QUERIES[name] = lambda spark, d: run(spark, d, sql, params)
    SQL[name] = oracle or sql


def op(name: str, oracle: str | None = None):
    """A query made of operators."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


# Flagship
both("flagship_revenue_by_nation", """
SELECT n.n_name, COUNT(DISTINCT o.o_orderkey) AS orders, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name HAVING COUNT(DISTINCT o.o_orderkey) > 5 ORDER BY revenue DESC NULLS LAST, n.n_name LIMIT 10""")

# Scan, filter, expressions
both("scan_project", "SELECT o_orderkey, o_totalprice * 2 AS double_price, o_orderstatus AS status FROM orders")
both("filter_and_or_not", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 100000) AND NOT (o_custkey < 50)")
both("filter_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount NOT BETWEEN 0.02 AND 0.05")
both("filter_in", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) OR p_brand IN ('Brand#11', 'Brand#22')")
both("filter_not_in", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, 2, 3)")
both("filter_in_empty", "SELECT count(*) AS n FROM part WHERE p_size IN ()", "SELECT count(*) AS n FROM part WHERE FALSE")
both("filter_not_in_empty", "SELECT count(*) AS n FROM part WHERE p_size NOT IN ()", "SELECT count(*) AS n FROM part WHERE TRUE")
both("filter_is_null", "SELECT count(*) AS n, count(CASE WHEN lang IS NULL THEN 1 END) AS without FROM documents WHERE lang IS NULL OR lang IS NOT NULL")
both("filter_is_value", "SELECT doc_id FROM documents WHERE lang IS 'en'", "SELECT doc_id FROM documents WHERE lang IS NOT DISTINCT FROM 'en'")
both("filter_is_not_value", "SELECT doc_id FROM documents WHERE lang IS NOT 'en'", "SELECT doc_id FROM documents WHERE lang IS DISTINCT FROM 'en'")
both("filter_like_ci", "SELECT p_partkey FROM part WHERE p_name LIKE '%A%b_'", "SELECT p_partkey FROM part WHERE p_name ILIKE '%A%b_'")
both("filter_like_escape", "SELECT count(*) AS n FROM documents WHERE text LIKE '%100!%%' ESCAPE '!'", "SELECT count(*) AS n FROM documents WHERE text ILIKE '%100!%%' ESCAPE '!'")
both("filter_glob", "SELECT p_partkey FROM part WHERE p_brand GLOB 'Brand#[1-2]?' AND p_type NOT GLOB '*x*'")
both("filter_regexp", "SELECT p_partkey FROM part WHERE p_brand REGEXP '#1[0-9]$'", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#1[0-9]$')")
both("filter_pk_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 4")
both("filter_range_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 500")
both("filter_params", "SELECT c_custkey FROM customer WHERE c_acctbal > ? AND c_mktsegment = ?", "SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'", [5000, "BUILDING"])
both("filter_params_named", "SELECT c_custkey FROM customer WHERE c_acctbal > :low AND c_acctbal < @high AND c_nationkey <> $3", "SELECT c_custkey FROM customer WHERE c_acctbal > 1000 AND c_acctbal < 4000 AND c_nationkey <> 7", {"low": 1000, "high": 4000, "3": 7})
both("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s FROM orders")
both("case_searched", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' END AS band FROM customer")
both("null_functions", "SELECT doc_id, coalesce(lang, source, 'x') AS a, nullif(lang, 'en') AS b, ifnull(lang, '?') AS c, CASE WHEN lang IS NULL THEN 1 ELSE 0 END AS d FROM documents")
both("cast_try", "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS p, try_cast(o_orderstatus AS INTEGER) AS q FROM orders", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS p, try_cast(o_orderstatus AS INTEGER) AS q FROM orders")
both("arith_div_zero", "SELECT l_orderkey, l_linenumber, try_divide(l_extendedprice, l_linenumber - 1) AS q, try_mod(l_orderkey, l_linenumber - 1) AS r FROM lineitem",
     "SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_linenumber - 1, 0) AS q, l_orderkey % nullif(l_linenumber - 1, 0) AS r FROM lineitem")
both("int_division", "SELECT o_orderkey, o_orderkey div 7 AS q, o_orderkey % 7 AS r FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r FROM orders")
both("bitwise", "SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 3 AS o, shiftleft(p_partkey, 2) AS l, shiftright(p_partkey, 1) AS r, ~p_partkey AS n FROM part",
     "SELECT p_partkey, p_partkey & 12 AS a, p_partkey | 3 AS o, p_partkey << 2 AS l, p_partkey >> 1 AS r, ~p_partkey AS n FROM part")
both("concat_op", "SELECT c_custkey, c_name || '/' || c_mktsegment AS k FROM customer")
both("kleene_logic", "SELECT count(CASE WHEN (lang = 'en') IS NULL THEN 1 END) AS unknown, count(CASE WHEN lang = 'en' OR n_chars > 10 THEN 1 END) AS t FROM documents")

# Joins
both("join_inner", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 8000")
both("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 200000 GROUP BY c.c_custkey")
both("join_right", "SELECT n.n_name, count(s.s_suppkey) AS n FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000 GROUP BY n.n_name")
both("join_full", """SELECT a.k AS ak, b.k AS bk FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 150000) a
FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 1000) b ON a.k = b.k""")
both("join_cross", "SELECT r.r_name, count(*) AS n FROM region r CROSS JOIN nation n GROUP BY r.r_name")
both("join_comma_where", "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey")
both("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
both("join_theta", "SELECT a.n_name, count(*) AS n FROM nation a JOIN nation b ON a.n_nationkey > b.n_nationkey GROUP BY a.n_name")
both("join_multi_key", "SELECT a.l_orderkey, a.l_linenumber, b.l_partkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 45")
both("join_semi", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
both("join_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
both("join_null_keys", "SELECT count(*) AS n FROM (SELECT CASE WHEN lang = 'en' THEN doc_id END AS k FROM documents) a JOIN (SELECT CASE WHEN rating > 2 THEN doc_id END AS k FROM documents) b ON a.k = b.k")
both("join_using", "SELECT n_regionkey, count(*) AS n FROM nation JOIN (SELECT r_regionkey AS n_regionkey FROM region WHERE r_regionkey < 3) r USING (n_regionkey) GROUP BY n_regionkey")
both("join_natural", "SELECT count(*) AS n FROM nation NATURAL JOIN (SELECT n_nationkey, 1 AS flag FROM nation WHERE n_regionkey = 1) x")
both("join_lateral", "SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM customer c, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) o")
both("join_multiway", """SELECT r.r_name, count(*) AS n, round(sum(l.l_quantity), 2) AS q FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey JOIN part p ON p.p_partkey = l.l_partkey WHERE p.p_size > 20 GROUP BY r.r_name""")


@op("join_broadcast_ref", "SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def _(s, d):
    c = reference_join(load(s, d, "customer").select("c_custkey", "c_nationkey"), load(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return load(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")


@op("join_as_of", "SELECT a.event_id, b.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT user_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY value DESC) AS rn FROM events WHERE event_type = 'view') WHERE rn = 1) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def _(s, d):
    e = load(s, d, "events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return as_of_join(e.where("event_type = 'click'").select("user_id", "ts", "event_id"), views, ["user_id"], "ts", "ts", ["last_value"]).select("event_id", "last_value")


@op("join_version_diff", """SELECT k, v, _change_type FROM (
SELECT coalesce(b.c_custkey, a.c_custkey) AS k, CASE WHEN b.c_custkey IS NULL THEN a.v ELSE b.v END AS v,
CASE WHEN a.c_custkey IS NULL THEN 'INSERT' WHEN b.c_custkey IS NULL THEN 'DELETE' WHEN a.v IS DISTINCT FROM b.v THEN 'UPDATE' END AS _change_type
FROM (SELECT c_custkey, c_acctbal AS v FROM customer WHERE c_mktsegment <> 'BUILDING') a
FULL JOIN (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_acctbal + 1 ELSE c_acctbal END AS v FROM customer WHERE c_mktsegment <> 'MACHINERY') b ON a.c_custkey = b.c_custkey) WHERE _change_type IS NOT NULL""")
def _(s, d):
    c = load(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), "c_mktsegment")
    old, new = c.where("c_mktsegment <> 'BUILDING'").drop("c_mktsegment"), c.where("c_mktsegment <> 'MACHINERY'").drop("c_mktsegment")
    return version_diff(old, new.withColumn("v", F.expr("if(v < 0, v + 1, v)")), ["k"])


_NULLS = "SELECT c_custkey AS k, CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey END AS x, CASE WHEN c_nationkey % 2 = 1 THEN c_nationkey END AS y FROM customer"


@op("version_diff_nulls", "SELECT c_custkey AS k, 'UPDATE' AS _change_type FROM customer")
def _(s, d):
    """Values that move to a column beside them, which was null, are updates."""
    old = run(s, d, _NULLS)
    return version_diff(old, old.select("k", F.col("y").alias("x"), F.col("x").alias("y")), ["k"]).select("k", "_change_type")


@op("join_bucketed", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(s, d):
    orders, customers = load(s, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey"), load(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return bucketed_join(orders, customers, ["k"], 8).select("o_orderkey", "c_name")


@op("merge_hot_cold", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_acctbal + 5 ELSE c_acctbal END AS bal FROM customer")
def _(s, d):
    c = load(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("bal"))
    hot = c.where("bal < 0").withColumn("bal", F.col("bal") + 5).withColumn("version", F.lit(2))
    return merge_sorted([c.withColumn("version", F.lit(1)), hot], [F.col("c_custkey")], ["c_custkey"], "version").select("c_custkey", "bal")


# Aggregates
both("agg_global", "SELECT count(*) AS n, sum(l_quantity) AS q, round(avg(l_discount), 6) AS d, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem")
both("agg_empty_input", "SELECT count(*) AS n, sum(l_quantity) AS q, min(l_tax) AS t FROM lineitem WHERE l_orderkey < 0")
both("agg_empty_group", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey < 0 GROUP BY l_returnflag")
both("agg_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q, round(sum(l_extendedprice), 2) AS p FROM lineitem GROUP BY l_returnflag, l_linestatus")
both("agg_group_null_key", "SELECT lang, count(*) AS n, sum(n_chars) AS c FROM documents GROUP BY lang", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS c FROM documents GROUP BY lang")
both("agg_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 100000")
both("agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS c, count(DISTINCT o_orderpriority) AS p FROM orders GROUP BY o_orderstatus")
both("agg_sum_distinct", "SELECT sum(DISTINCT p_size) AS s FROM part", "SELECT CAST(sum(DISTINCT p_size) AS BIGINT) AS s FROM part")
both("agg_case_expr", "SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, round(sum(o_totalprice * 0.1 + 1), 2) AS x FROM orders GROUP BY o_orderpriority",
     "SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, round(sum(o_totalprice * 0.1 + 1), 2) AS x FROM orders GROUP BY o_orderpriority")
both("agg_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, round(sum(l_tax) FILTER (WHERE l_discount = 0), 4) AS t FROM lineitem GROUP BY l_returnflag")
both("agg_total", "SELECT TOTAL(l_quantity) AS t, total(CASE WHEN l_orderkey < 0 THEN 1 END) AS z FROM lineitem", "SELECT coalesce(sum(CAST(l_quantity AS DOUBLE)), 0) AS t, CAST(0 AS DOUBLE) AS z FROM lineitem")
both("agg_group_concat", "SELECT n_regionkey, group_concat(n_name, ';') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
both("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
both("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
both("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))")
both("agg_stddev_var", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS s, round(var_pop(l_quantity), 6) AS v FROM lineitem GROUP BY l_returnflag")
both("distinct_rows", "SELECT DISTINCT l_shipmode_like, l_linestatus FROM (SELECT l_quantity AS l_shipmode_like, l_linestatus FROM lineitem) x")


@op("agg_group_concat_distinct", "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS p FROM orders GROUP BY o_orderstatus")
def _(s, d):
    return load(s, d, "orders").groupBy("o_orderstatus").agg(group_concat(F.col("o_orderpriority"), distinct=True).alias("p"))


@op("agg_group_concat_ordered", "SELECT c_nationkey, string_agg(c_custkey, '|' ORDER BY c_acctbal, c_custkey) AS ids FROM customer GROUP BY c_nationkey")
def _(s, d):
    return load(s, d, "customer").groupBy("c_nationkey").agg(group_concat(F.col("c_custkey"), "|", F.struct("c_acctbal", "c_custkey")).alias("ids"))


@op("agg_json_array", "SELECT n_regionkey, replace(to_json(list(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END ORDER BY n_nationkey))::VARCHAR, ' ', '') AS j FROM nation GROUP BY n_regionkey")
def _(s, d):
    return load(s, d, "nation").groupBy("n_regionkey").agg(json_group_array(F.expr("if(n_nationkey % 2 = 0, n_nationkey, null)"), F.col("n_nationkey")).alias("j"))


@op("agg_json_object", "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS j FROM nation GROUP BY n_regionkey")
def _(s, d):
    return load(s, d, "nation").groupBy("n_regionkey").agg(json_group_object(F.col("n_name"), F.col("n_nationkey")).alias("j"))


@op("agg_partial_avg", "SELECT l_suppkey, round(avg(l_extendedprice), 4) AS a, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def _(s, d):
    part = load(s, d, "lineitem").groupBy("l_suppkey", F.pmod("l_orderkey", F.lit(8)).alias("shard")).agg(F.sum("l_extendedprice").alias("_s"), F.count("l_extendedprice").alias("_c"))
    return part.groupBy("l_suppkey").agg(F.round(F.sum("_s") / F.sum("_c"), 4).alias("a"), F.sum("_c").alias("n"))


@op("agg_total_operator", "SELECT lang, CAST(coalesce(sum(CASE WHEN n_chars > 1000 THEN n_chars END), 0) AS DOUBLE) AS t FROM documents GROUP BY lang")
def _(s, d):
    return load(s, d, "documents").groupBy("lang").agg(total(F.expr("if(n_chars > 1000, n_chars, null)")).alias("t"))


# Windows
both("win_row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")
both("win_rank_dense", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS dr FROM part")
both("win_ntile", "SELECT c_custkey, ntile(7) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS b FROM customer")
both("win_percent_cume", "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 8) AS p, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 8) AS c FROM part")
both("win_lag_lead", "SELECT o_orderkey, lag(o_totalprice, 1, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders",
     "SELECT o_orderkey, lag(o_totalprice, 1, CAST(-1 AS DOUBLE)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders")
both("win_first_last_nth", """SELECT o_orderkey, first_value(o_totalprice) OVER w AS f, last_value(o_totalprice) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n2
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
both("win_sum_rows", "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM lineitem")
both("win_frame_after", "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS s FROM lineitem")
both("win_sum_range", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM part")
both("win_default_frame", "SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS running, sum(p_size) OVER (PARTITION BY p_brand) AS whole FROM part",
     "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS running, CAST(sum(p_size) OVER (PARTITION BY p_brand) AS BIGINT) AS whole FROM part")
both("win_filter", "SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f FROM orders")
both("win_named", "SELECT o_orderkey, sum(o_totalprice) OVER w AS s, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 2 PRECEDING)")


@op("win_multi_spec", "SELECT c_custkey, rank() OVER (ORDER BY c_acctbal DESC, c_custkey) AS a, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS b, max(c_acctbal) OVER (PARTITION BY c_mktsegment) AS m FROM customer")
def _(s, d):
    """An order over all rows is numbered by ranges; no window is without a partition."""
    rows = numbered(load(s, d, "customer"), [F.desc("c_acctbal"), F.asc("c_custkey")], "a")
    b, m = F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("c_custkey"))), F.max("c_acctbal").over(W.partitionBy("c_mktsegment"))
    return rows.select("c_custkey", "a", b.alias("b"), m.alias("m"))


both("win_nulls_last", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY lang NULLS LAST, doc_id) AS rn FROM documents")


@op("win_groups", "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM part")
def _(s, d):
    return groups_frame(load(s, d, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], [F.col("p_size")], -1, 1, s=lambda: F.sum("p_size")).select("p_partkey", "s")


_EX = "SELECT p_partkey, round(CAST(sum(p_retailprice) OVER w AS DOUBLE), 4) AS x_sum, CAST(count(p_retailprice) OVER w AS INTEGER) AS x_count, min(p_retailprice) OVER w AS x_min FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE {})"
for _name, _kind in (("win_exclude_current", "current row"), ("win_exclude_no_others", "no others")):
    op(_name, _EX.format(_kind.upper()))(lambda s, d, k=_kind: excluding(load(s, d, "part"), ["p_brand"], [F.col("p_size"), F.col("p_partkey")], (-3, 3), k, "p_retailprice", "x").select("p_partkey", F.round("x_sum", 4).alias("x_sum"), "x_count", "x_min"))
# Peers only matter if the order has ties: a frame over all rows, ordered by size alone.
_TIES = "SELECT c_custkey, CAST(count(c_acctbal) OVER w AS INTEGER) AS x_count, max(c_acctbal) OVER w AS x_max FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE {})"
for _name, _kind in (("win_exclude_group", "group"), ("win_exclude_ties", "ties")):
    op(_name, _TIES.format(_kind.upper()))(lambda s, d, k=_kind: excluding(load(s, d, "customer"), ["c_nationkey"], [F.col("c_mktsegment")], (W.unboundedPreceding, W.unboundedFollowing), k, "c_acctbal", "x").select("c_custkey", "x_count", "x_max"))

# Sort and top-k: the place in the order is a column, as results are compared without order.
both("topk_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
for _name, _by, _order in (
    ("sort_nulls_first", "ASC NULLS FIRST", lambda: F.asc_nulls_first("lang")), ("sort_nulls_last", "DESC NULLS LAST", lambda: F.desc_nulls_last("lang")),
):
    op(_name, f"SELECT doc_id, row_number() OVER (ORDER BY lang {_by}, doc_id) AS at FROM documents")(lambda s, d, o=_order: numbered(load(s, d, "documents").select("doc_id", "lang"), [o(), F.asc("doc_id")], "at").drop("lang"))
both("sort_expr", "SELECT c_custkey FROM customer ORDER BY CASE WHEN c_acctbal < 0 THEN 0 ELSE 1 END, abs(c_acctbal) DESC, c_custkey LIMIT 20")
both("sort_ordinal", "SELECT c_custkey, c_acctbal FROM customer ORDER BY 2 DESC NULLS LAST, 1 LIMIT 15")
op("sort_nocase", "SELECT p_partkey, row_number() OVER (ORDER BY lower(p_name), p_partkey) AS at FROM part")(lambda s, d: numbered(load(s, d, "part").select("p_partkey", F.collate("p_name", "UTF8_LCASE").alias("k")), [F.asc("k"), F.asc("p_partkey")], "at").drop("k"))
both("sort_by_subquery", "SELECT n_name FROM (SELECT n_name, (SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey) AS k FROM nation n) ORDER BY k DESC, n_name LIMIT 5")


@op("topk_operator", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25 OFFSET 3")
def _(s, d):
    return top_n(load(s, d, "lineitem"), [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 25, 3).select("l_orderkey", "l_linenumber")


# Set operations
_A, _B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000", "SELECT s_nationkey AS other FROM supplier WHERE s_acctbal > 2000"
for _name, _word in (("union_distinct", "UNION"), ("union_all", "UNION ALL"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    both(_name, f"{_A} {_word} {_B}")
both("compound_order_limit", "SELECT n_name AS x FROM nation UNION SELECT r_name FROM region ORDER BY x DESC LIMIT 7 OFFSET 2")
both("compound_precedence", "SELECT n_nationkey AS k FROM nation UNION SELECT 100 INTERSECT SELECT r_regionkey FROM region")
both("set_null_rows", "SELECT lang FROM documents INTERSECT SELECT nullif(lang, 'en') FROM documents")

# CTEs and subqueries
both("cte_simple", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT o_custkey FROM big WHERE t > 500000")
both("cte_chain", "WITH a (k, t) AS (SELECT o_custkey, sum(o_totalprice) FROM orders GROUP BY o_custkey), b AS (SELECT k FROM a WHERE t > (SELECT avg(t) FROM a)) SELECT c_name FROM customer JOIN b ON c_custkey = k")
both("cte_recursive_all", "WITH RECURSIVE t (n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n, n * n AS sq FROM t")


@op("cte_recursive_distinct", "WITH RECURSIVE r (k) AS (SELECT CAST(0 AS BIGINT) UNION SELECT (k * 3 + n_nationkey) % 40 FROM r, nation) SELECT k FROM r")
def _(s, d):
    n = load(s, d, "nation").select("n_nationkey")
    return recursive_distinct(s.range(1).select(F.col("id").alias("k")), lambda new: new.join(n, F.lit(True)).select(((F.col("k") * 3 + F.col("n_nationkey")) % 40).alias("k")))


both("sub_scalar", "SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
both("sub_scalar_empty", "SELECT (SELECT max(o_orderkey) FROM orders WHERE o_orderkey < 0) AS m, n_name FROM nation")
both("sub_scalar_corr", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS m FROM customer c")
both("sub_in", "SELECT c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
both("sub_not_in_null", "SELECT count(*) AS n FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey = 1 THEN NULL ELSE r_regionkey END FROM region)")
both("sub_exists", "SELECT s_name FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49)")
both("sub_not_exists", "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 40)")
both("sub_any", "SELECT c_custkey FROM customer WHERE c_acctbal > ANY (SELECT s_acctbal FROM supplier WHERE s_nationkey < 5)")
both("sub_all", "SELECT c_custkey FROM customer WHERE c_acctbal >= ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey < 5)")
both("sub_all_empty", "SELECT count(*) AS n FROM customer WHERE c_acctbal < ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey < 0)")
both("sub_eq_any", "SELECT n_name FROM nation WHERE n_nationkey = SOME (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
both("sub_ne_all", "SELECT n_name FROM nation WHERE n_nationkey <> ALL (SELECT c_nationkey FROM customer WHERE c_acctbal > 9800)")
both("sub_tuple_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT l_orderkey, max(l_linenumber) FROM lineitem GROUP BY l_orderkey)")
both("sub_derived", "SELECT x.k, x.n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) AS x WHERE x.n > 10")
both("sub_in_corr", "SELECT o_orderkey FROM orders o WHERE o.o_orderkey IN (SELECT l.l_orderkey FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)")
both("values_table", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)")
