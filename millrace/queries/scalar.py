"""Scalar functions over whole tables, beside SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import conditional as cd
from ..functions import dates as dt
from ..functions import jsons as js
from ..functions import maths as mt
from ..functions import strings as st
from ..functions import vectors as ve
from ..session import load, ship

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


def over(table: str, key: str):
    """A query that selects columns of a table beside its key."""
    return lambda s, d, /, **cols: load(s, d, table).select(key, *[v.alias(k) for k, v in cols.items()])


docs, parts, orders, customers, events = over("documents", "doc_id"), over("part", "p_partkey"), over("orders", "o_orderkey"), over("customer", "c_custkey"), over("events", "event_id")

op("str_case_trim", r"SELECT doc_id, upper(source) AS u, lower(title) AS l, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, ltrim(title, 'L') AS lt, rtrim(title, 'te') AS rt, trim(title, 'Le') AS bt FROM documents")(
    lambda s, d: docs(s, d, u=F.upper("source"), l=F.lower("title"), t=st.trim(c("text")), lt=st.ltrim(c("title"), "L"), rt=st.rtrim(c("title"), "te"), bt=st.trim(c("title"), "Le")))
op("str_length", "SELECT doc_id, CAST(length(text) AS INTEGER) AS n, CAST(strlen(text) AS INTEGER) AS b FROM documents")(lambda s, d: docs(s, d, n=F.char_length("text"), b=F.octet_length("text")))
op("str_substr", "SELECT p_partkey, substr(p_name, 2, 4) AS a, substr(p_name, 1, 3) AS z, right(p_name, 3) AS r, p_name AS far FROM part")(
    lambda s, d: parts(s, d, a=st.substr(c("p_name"), 2, 4), z=st.substr(c("p_name"), 0, 3), r=st.substr(c("p_name"), -3), far=st.substr(c("p_name"), -500)))
op("str_replace_instr", "SELECT doc_id, replace(text, 'the', 'THE') AS r, CAST(instr(text, 'the') AS INTEGER) AS i FROM documents")(lambda s, d: docs(s, d, r=F.replace("text", lit("the"), lit("THE")), i=F.instr("text", "the")))
op("str_printf", "SELECT p_partkey, printf('%s has %d, %.2f%% %5d|%-6d|%x', p_brand, p_size, p_retailprice, p_size, p_size, p_partkey) AS f FROM part")(
    lambda s, d: parts(s, d, f=st.printf("%s has %d, %.2f%% %5d|%-6d|%x", c("p_brand"), c("p_size"), c("p_retailprice"), c("p_size"), c("p_size"), c("p_partkey"))))
op("str_printf_null", "SELECT doc_id, coalesce(lang, 'NULL') || ':' || CASE WHEN lang IS NULL THEN '  NULL' ELSE lpad(lang, 6, ' ') END AS f FROM documents")(lambda s, d: docs(s, d, f=st.printf("%s:%6s", c("lang"), c("lang"))))
op("str_printf_general", "SELECT p_partkey, printf('%g', p_retailprice / 7) AS g, printf('%.3g', p_retailprice * 1000 / 7 + 0.123) AS h, printf('%e', p_retailprice) AS e FROM part")(
    lambda s, d: parts(s, d, g=st.printf("%g", c("p_retailprice") / 7), h=st.printf("%.3g", c("p_retailprice") * 1000 / 7 + 0.123), e=st.printf("%e", c("p_retailprice"))))
op("str_quote_hex", "SELECT doc_id, CASE WHEN lang IS NULL THEN 'NULL' ELSE '''' || replace(lang, '''', '''''') || '''' END AS q, coalesce('''' || replace(title, '''', '''''') || '''', 'NULL') AS t, hex(title) AS h, title AS back FROM documents")(
    lambda s, d: docs(s, d, q=st.quote(c("lang")), t=st.quote(c("title")), h=F.hex("title"), back=F.decode(st.unhex(F.hex("title")), "UTF-8")))
op("str_concat_ws", "SELECT doc_id, concat(lang, '-', source) AS k, concat_ws('/', lang, source, title) AS w FROM documents")(lambda s, d: docs(s, d, k=st.concat(c("lang"), lit("-"), c("source")), w=F.concat_ws("/", "lang", "source", "title")))
op("str_char_unicode", "SELECT p_partkey, chr(65 + CAST(p_partkey % 26 AS INTEGER)) || chr(8364) || chr(128512) AS s, unicode(p_name) AS u FROM part")(
    lambda s, d: parts(s, d, s=st.char(65 + c("p_partkey") % 26, lit(8364), lit(128512)), u=st.unicode(c("p_name"))))
op("str_glob_like_functions", "SELECT p_partkey, p_brand GLOB 'Brand#[1-3]*' AS g, p_type ILIKE '%STEEL%' AS l FROM part")(lambda s, d: parts(s, d, g=st.glob("Brand#[1-3]*", c("p_brand")), l=c("p_type").ilike("%STEEL%")))
op("str_zeroblob", "SELECT p_partkey, repeat('00', p_size) AS z FROM part")(lambda s, d: parts(s, d, z=F.hex(st.zeroblob(c("p_size")))))
op("cond_decode_nvl2", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'English' WHEN lang = 'de' THEN 'German' ELSE 'other' END AS d, CASE WHEN lang IS NOT NULL THEN 'set' ELSE 'unset' END AS n, CASE WHEN helpful_votes <> 0 THEN 'yes' ELSE 'no' END AS i FROM documents")(
    lambda s, d: docs(s, d, d=cd.decode(c("lang"), lit("en"), lit("English"), lit("de"), lit("German"), lit(None), lit("never"), lit("other")), n=cd.nvl2(c("lang"), lit("set"), lit("unset")), i=cd.iif(cd.truthy(c("helpful_votes"), "int"), lit("yes"), lit("no"))))

op("math_round_sign", "SELECT c_custkey, floor(c_acctbal * 10 + 0.5) / 10 AS r, CAST(sign(c_acctbal) AS DOUBLE) AS s, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(trunc(c_acctbal) AS BIGINT) AS t, abs(c_acctbal) AS a, round(c_acctbal, 1) AS h FROM customer")(
    lambda s, d: customers(s, d, r=mt.round_half_up(c("c_acctbal"), 1), s=F.signum("c_acctbal"), c=F.ceil("c_acctbal"), f=F.floor("c_acctbal"), t=mt.trunc(c("c_acctbal")), a=F.abs("c_acctbal"), h=F.round("c_acctbal", 1)))
op("math_pow_log", "SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, 8) AS q, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 8) AS n, round(CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END, 8) AS l, round(CASE WHEN c_acctbal > 0 THEN log2(c_acctbal) END, 8) AS b, pow(c_nationkey, 2) AS p, round(exp(c_nationkey / 10), 8) AS e FROM customer")(
    lambda s, d: customers(s, d, q=F.round(mt.sqrt(c("c_acctbal")), 8), n=F.round(mt.ln(c("c_acctbal")), 8), l=F.round(mt.log10(c("c_acctbal")), 8), b=F.round(mt.log2(c("c_acctbal")), 8), p=F.pow("c_nationkey", lit(2)), e=F.round(F.exp(c("c_nationkey") / 10), 8)))
op("math_trig", "SELECT c_custkey, round(sin(c_acctbal), 8) AS s, round(cos(c_acctbal), 8) AS k, round(CASE WHEN c_nationkey / 10.0 BETWEEN -1 AND 1 THEN asin(least(1, c_nationkey / 10.0)) END, 8) AS a, round(atan2(c_acctbal, c_nationkey), 8) AS t, round(degrees(c_nationkey), 8) AS g, round(radians(c_acctbal), 8) AS r, round(pi(), 8) AS p FROM customer")(
    lambda s, d: customers(s, d, s=F.round(F.sin("c_acctbal"), 8), k=F.round(F.cos("c_acctbal"), 8), a=F.round(mt.asin(c("c_nationkey") / 10.0), 8), t=F.round(F.atan2("c_acctbal", "c_nationkey"), 8), g=F.round(F.degrees("c_nationkey"), 8), r=F.round(F.radians("c_acctbal"), 8), p=F.round(F.pi(), 8)))
op("math_minmax_scalar", "SELECT doc_id, greatest(rating, helpful_votes, 2) AS g, least(rating, helpful_votes, 2) AS l FROM documents")(lambda s, d: docs(s, d, g=mt.largest(c("rating"), c("helpful_votes"), lit(2)), l=mt.smallest(c("rating"), c("helpful_votes"), lit(2))))
op("math_mod", "SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) % nullif(c_nationkey, 0) AS m FROM customer")(lambda s, d: customers(s, d, m=mt.mod(mt.trunc(c("c_acctbal")), c("c_nationkey"))))
op("math_number", "SELECT doc_id, try_cast(trim(title) AS DOUBLE) AS t, CAST(rating AS DOUBLE) AS r FROM documents")(lambda s, d: docs(s, d, t=mt.number(c("title")), r=mt.number(c("rating"))))

_T = "ts"
op("date_parts", "SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, strftime(ts, '%Y-%m-%d') AS dd, strftime(ts, '%H:%M:%S') AS tt, strftime(ts, '%Y-%m-%d %H:%M:%S') AS dt FROM events")(
    lambda s, d: events(s, d, y=F.year(_T), m=F.month(_T), d=F.day(_T), h=F.hour(_T), mi=F.minute(_T), dd=dt.date(c(_T)), tt=dt.time(c(_T)), dt=dt.datetime(c(_T))))
op("date_modifiers", "SELECT event_id, strftime(ts + INTERVAL 3 DAY - INTERVAL 5 HOUR + INTERVAL 90 SECOND, '%Y-%m-%d %H:%M:%S') AS a FROM events")(lambda s, d: events(s, d, a=dt.datetime(c(_T), "+3 days", "-5 hours", "+90 seconds")))
op("date_start_of", "SELECT event_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS d, strftime(date_trunc('month', ts), '%Y-%m-%d') AS m, strftime(date_trunc('year', ts), '%Y-%m-%d') AS y FROM events")(
    lambda s, d: events(s, d, d=dt.datetime(c(_T), "start of day"), m=dt.date(c(_T), "start of month"), y=dt.date(c(_T), "start of year")))
op("date_weekday", "SELECT event_id, strftime(ts + INTERVAL (CASE WHEN (8 - dayofweek(ts)) % 7 = 0 THEN 7 ELSE (8 - dayofweek(ts)) % 7 END) DAY, '%Y-%m-%d') AS monday FROM events")(lambda s, d: events(s, d, monday=dt.date(c(_T), "weekday 1")))
op("date_strftime", "SELECT event_id, strftime(ts, '%d/%m/%Y %H.%M.%S day %j of %w, %% %U %W') AS f, strftime(ts, '%S.%g') AS fr, strftime(ts, '%I') AS i FROM events")(
    lambda s, d: events(s, d, f=dt.strftime("%d/%m/%Y %H.%M.%S day %j of %w, %% %U %W", c(_T)), fr=dt.strftime("%f", c(_T)), i=dt.strftime("%I", c(_T))))
op("date_julian", "SELECT event_id, floor(epoch_us(ts) / 1000) / 86400000.0 + 2440587.5 AS j FROM events")(lambda s, d: events(s, d, j=dt.julianday(c(_T))))
op("date_unixepoch", "SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS u, floor(epoch_us(ts) / 1000) / 1000.0 AS v FROM events")(lambda s, d: events(s, d, u=dt.unixepoch(c(_T)), v=dt.unixepoch(c(_T), subsecond=True)))
op("date_timediff", "SELECT doc_id, CASE WHEN n < 0 THEN '-' ELSE '' END || printf('%02d:%02d:%02d.%03d', abs(n) // 3600000, abs(n) // 60000 % 60, abs(n) // 1000 % 60, abs(n) % 1000) AS t FROM (SELECT doc_id, CAST(floor(epoch_us(loaded_at) / 1000) - floor(epoch_us(review_date) / 1000) AS BIGINT) AS n FROM documents)")(
    lambda s, d: docs(s, d, t=dt.timediff(c("loaded_at"), c("review_date"))))
op("date_month_overflow", "SELECT event_id, strftime(date_trunc('month', ts) + INTERVAL 1 MONTH + (ts - date_trunc('month', ts)), '%Y-%m-%d %H:%M:%S') AS m, strftime(date_trunc('month', ts) + INTERVAL 12 MONTH + (ts - date_trunc('month', ts)), '%Y-%m-%d') AS y FROM events")(
    lambda s, d: events(s, d, m=dt.datetime(c(_T), "+1 month"), y=dt.date(c(_T), "+1 year")))
op("date_parse_text", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts, '%Y-%m-%d') AS b FROM events")(
    lambda s, d: events(s, d, a=dt.datetime(dt.parse(dt.datetime(c(_T)))), b=dt.date(dt.parse(dt.unixepoch(c(_T)).cast("string")))))

op("json_valid", "SELECT delivery_id, CASE WHEN after_json IS NOT NULL AND json_valid(after_json) THEN 1 ELSE 0 END AS v FROM cdc_events")(lambda s, d: load(s, d, "cdc_events").select("delivery_id", js.json_valid(c("after_json")).alias("v")))
op("json_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS t, json_extract_string(props, '$.none') AS n FROM events")(
    lambda s, d: events(s, d, k=js.json_extract(c("props"), "$.k", "bigint"), t=js.json_extract(c("props"), "$.k"), n=js.json_extract(c("props"), "$.none")))
op("json_extract_many", "SELECT event_id, '[' || json_extract_string(props, '$.k') || ',null]' AS a FROM events")(lambda s, d: events(s, d, a=js.json_extract_many(c("props"), "$.k", "$.none")))
op("json_type", "SELECT delivery_id, lower(CASE json_type(after_json, '$.id') WHEN 'VARCHAR' THEN 'text' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' ELSE json_type(after_json, '$.id') END) AS i, CASE json_type(after_json, '$.discontinued') WHEN 'BOOLEAN' THEN json_extract_string(after_json, '$.discontinued') WHEN 'VARCHAR' THEN 'text' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' ELSE lower(json_type(after_json, '$.discontinued')) END AS d, lower(json_type(after_json)) AS r FROM cdc_events")(
    lambda s, d: load(s, d, "cdc_events").select("delivery_id", js.json_type(c("after_json"), "$.id").alias("i"), js.json_type(c("after_json"), "$.discontinued").alias("d"), js.json_type(c("after_json")).alias("r")))
op("json_array_object", """SELECT c_custkey, '[' || c_custkey || ',"' || c_mktsegment || '",null]' AS a, '{"id":' || c_custkey || ',"seg":"' || c_mktsegment || '"}' AS o FROM customer""")(
    lambda s, d: customers(s, d, a=js.json_array(c("c_custkey"), c("c_mktsegment"), lit(None).cast("string")), o=js.json_object(lit("id"), c("c_custkey"), lit("seg"), c("c_mktsegment"))))
op("json_array_length", "SELECT event_id, 2 AS n, CAST(NULL AS INTEGER) AS z FROM events")(lambda s, d: events(s, d, n=js.json_array_length(F.concat(lit('{"a":['), c("event_id").cast("string"), lit(",1]}")), "$.a"), z=js.json_array_length(c("props"))))


@op("json_set_insert_replace", """SELECT event_id, '{"k":0,"n":' || event_id || '}' AS s, '{"k":' || json_extract_string(props, '$.k') || ',"n":' || event_id || '}' AS i, '{"k":' || event_id || '}' AS r FROM events""")
def _(s, d):
    ship(s)
    p, e = c("props"), c("event_id").cast("string")
    return events(s, d, s=js.json_set(p, "$.k", lit("0"), "$.n", e), i=js.json_insert(p, "$.k", lit("0"), "$.n", e), r=js.json_replace(p, "$.k", e, "$.n", e))


@op("json_remove", "SELECT event_id, '{}' AS r FROM events")
def _(s, d):
    ship(s)
    return events(s, d, r=js.json_remove(c("props"), "$.k"))


@op("json_patch", """SELECT event_id, '{"m":' || event_id || '}' AS r FROM events""")
def _(s, d):
    ship(s)
    return events(s, d, r=js.json_patch(c("props"), F.concat(lit('{"k":null,"m":'), c("event_id").cast("string"), lit("}"))))


op("json_each", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value, 'integer' AS type, '$.k' AS fullkey FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")(
    lambda s, d: js.json_each(load(s, d, "events").select("event_id", "props"), "props").select("event_id", "key", "value", "type", "fullkey"))


@op("json_tree", "SELECT event_id, unnest([0, 1]) AS id, unnest(['$', '$.k']) AS fullkey, unnest(['object', 'integer']) AS type FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def _(s, d):
    ship(s)
    s.udtf.register("json_tree", js.json_tree_udtf())
    load(s, d, "events").select("event_id", "props").createOrReplaceTempView("mr_events_props")
    return s.sql("SELECT event_id, t.id, t.fullkey, t.type FROM mr_events_props, LATERAL json_tree(props) t")


vecs = over("embeddings", "vec_id")
_Q = "(SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings ORDER BY vec_id LIMIT 1)"
_V = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
op("vec_ops", f"SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(sqrt(list_sum(list_transform({_V}, lambda x: x * x))), 6) AS norm, round(list_sum(list_transform({_V}, lambda x: x * 2 + x)), 6) AS s, CAST(0 AS DOUBLE) AS z, CAST(len(list_filter(embedding, lambda x: x > 0.5)) AS INTEGER) AS h FROM embeddings")(
    lambda s, d: vecs(s, d, n=ve.dims(c("embedding")), norm=F.round(ve.norm(c("embedding")), 6), s=F.round(ve._sum(ve.add(ve.scale(c("embedding"), 2.0), c("embedding"))), 6), z=ve._sum(ve.subtract(c("embedding"), c("embedding"))), h=ve.hamming(c("embedding"), F.transform("embedding", lambda x: x * 0))))
op("vec_normalize", "SELECT vec_id, CAST(1.0 AS DOUBLE) AS n FROM embeddings")(lambda s, d: vecs(s, d, n=F.round(ve.norm(ve.normalize(c("embedding"))), 6)))
op("vec_quantize", "SELECT vec_id, TRUE AS close FROM embeddings")(
    lambda s, d: vecs(s, d, close=F.forall(F.zip_with("embedding", ve.dequantize(ve.quantize_int8(c("embedding"))), lambda a, b: F.abs(a - b)), lambda e: e <= ve.quantize_int8(c("embedding"))["scale"] * 0.5001)))
op("vec_hamming", "SELECT vec_id, CAST(bit_count(vec_id # 5) + bit_count(vec_id # 9) AS INTEGER) AS h FROM embeddings".replace("vec_id # 5", "xor(vec_id, 5)").replace("vec_id # 9", "xor(vec_id, 9)"))(
    lambda s, d: vecs(s, d, h=ve.hamming_packed(F.array("vec_id", "vec_id"), F.array(lit(5).cast("bigint"), lit(9).cast("bigint")))))
op("vec_text_roundtrip", "SELECT vec_id, TRUE AS same FROM embeddings")(lambda s, d: vecs(s, d, same=ve.vector(ve.vector_extract(c("embedding"))) == c("embedding")))
