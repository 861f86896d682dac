"""A database over lake tables that is spoken to in SQL: queries, changes, definitions, constraints, time travel, branches, transactions."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lake import files
from ..lake.tables import Conflict, LakeTable
from ..operators.relational import recursive_distinct
from ..session import durable, shared_path
from ..sources.readers import open_source
from .dialect import bind, table_of, translate
from .routines import install, rewrite_calls
from .lexer import Token, after, closing, find, lex, name, solid, split, text

# Declared type names and what they are here.
TYPES = {
    "INTEGER": "bigint", "INT": "bigint", "BIGINT": "bigint", "SMALLINT": "bigint", "TINYINT": "bigint", "MEDIUMINT": "bigint", "INT2": "bigint", "INT8": "bigint",
    "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "NUMERIC": "double", "DECIMAL": "double", "TEXT": "string", "VARCHAR": "string", "CHAR": "string", "CLOB": "string",
    "NCHAR": "string", "NVARCHAR": "string", "BLOB": "binary", "NONE": "binary", "DATE": "date", "DATETIME": "timestamp", "TIMESTAMP": "timestamp", "TIME": "string",
    "BOOLEAN": "boolean", "BOOL": "boolean", "JSON": "string", "JSONB": "string", "UUID": "string",
}


def affinity(declared: str) -> str:
    """INTEGER, TEXT, BLOB, REAL or NUMERIC of a declared type, by the parts of its name."""
    d = declared.upper()
    for parts, a in ((("INT",), "INTEGER"), (("CHAR", "CLOB", "TEXT"), "TEXT"), (("BLOB",), "BLOB"), (("REAL", "FLOA", "DOUB"), "REAL")):
        if any(p in d for p in parts):
            return a
    return "NUMERIC" if d.strip() else "BLOB"


class ConstraintError(ValueError):
    """Rows that a constraint forbids."""


@dataclass
class Table:
    """What a database knows of a table beside its rows."""

    name: str
    columns: list[tuple[str, str]]
    key: list[str] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    defaults: dict[str, str] = field(default_factory=dict)
    foreign: list[tuple[list[str], str, list[str], str, str]] = field(default_factory=list)  # columns, parent, its columns, ON DELETE, ON UPDATE
    generated: dict[str, str] = field(default_factory=dict)
    indexes: dict[str, list[str]] = field(default_factory=dict)

    def changed_uniques(self, columns) -> list[list[str]]:
        """Keys that a change of columns may break."""
        return [u for u in ([self.key] if self.key else []) + self.unique if set(u) & set(columns)]


@dataclass
class Trigger:
    """A trigger in SQL: before, after or instead of an event on a table or view, perhaps only for some columns or rows."""

    name: str
    timing: str
    event: str
    table: str
    columns: list[str]
    when: str | None
    body: list[str]


def _spark_type(tokens: list[Token]) -> str:
    t = text(tokens).strip()
    base = re.match(r"\w*", t)[0].upper()
    m = re.search(r"\((\d+)\s*(?:,\s*(\d+))?\)", t)
    if base in ("DECIMAL", "NUMERIC") and m:
        return f"decimal({m[1]},{m[2] or 0})"
    return TYPES.get(base) or {"INTEGER": "bigint", "TEXT": "string", "BLOB": "binary", "REAL": "double", "NUMERIC": "double"}[affinity(base)]


class Database:
    """sql() runs one statement and returns a DataFrame: rows of a query or of RETURNING, else a row with the number of changes.

    Definitions (tables, constraints, views, triggers in SQL) are stored beside the tables and found by the next Database on the path. Between
    BEGIN and COMMIT all tables are read as they were at BEGIN and written to a branch nobody else sees; COMMIT moves the tables forward, or raises
    Conflict if somebody else has written one of them. Definitions take effect at once.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, (path or shared_path(spark, "db")).rstrip("/"), read_only
        self.tables: dict[str, Table] = {}
        self.views: dict[str, str] = {}
        self.checked_views: list[str] = []
        self.materialized: dict[str, str] = {}
        self.sql_triggers: dict[str, Trigger] = {}
        self.triggers: dict[str, tuple[str, str, str, Callable]] = {}
        self.procedures: dict[str, Callable] = {}
        self.attached: dict[str, "Database"] = {}
        self.sources: dict[str, DataFrame] = {}
        self.foreign_keys = False
        self._txn: dict | None = None
        self._depth = 0
        self._load()
        install(spark)

    def _load(self) -> None:
        known = files.names(self.spark, f"{self.path}/definitions")
        self._number = len(known)
        if known:
            d = files.get(self.spark, f"{self.path}/definitions/{known[-1]}")
            self.tables = {k: Table(**t | {"columns": [tuple(c) for c in t["columns"]], "foreign": [tuple(f) for f in t["foreign"]]}) for k, t in d["tables"].items()}
            self.views, self.checked_views, self.materialized = d["views"], d["checked_views"], d["materialized"]
            self.sql_triggers = {k: Trigger(**t) for k, t in d["triggers"].items()}

    def _save(self) -> None:
        """Store the definitions. Conflict if somebody else changed them since they were read."""
        d = {"tables": {k: asdict(t) for k, t in self.tables.items()}, "views": self.views, "checked_views": self.checked_views, "materialized": self.materialized, "triggers": {k: asdict(t) for k, t in self.sql_triggers.items()}}
        if not files.put(self.spark, f"{self.path}/definitions/{self._number:08d}.json", d):
            raise Conflict(f"somebody else changed the definitions of {self.path}")
        self._number += 1

    # Objects

    def lake(self, table: str) -> LakeTable:
        db, t = self._where(table)
        return LakeTable(db.spark, f"{db.path}/{t}")

    def _where(self, table: str) -> tuple["Database", str]:
        if "." in table:
            d, t = table.split(".", 1)
            if d == "main":
                return self, t
            if d not in self.attached:
                raise LookupError(f"no database {d}")
            return self.attached[d], t
        return self, table

    def table(self, table: str, branch: str = "main", version=None, timestamp=None, columns: list[str] | None = None, where: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        """Rows of a table, perhaps as it was, with what a reader may ask for."""
        db, t = self._where(table)
        if t in db.sources:
            df = db.sources[t]
        elif t in db.tables:
            df = db.lake(t).read(db._branch(t) if branch == "main" and version is None and timestamp is None else branch, version, timestamp)
        elif t in db.views:
            df = db.sql(db.views[t])
        else:
            raise LookupError(f"no table {table}")
        df = df.where(where) if where else df
        df = df.select(*columns) if columns else df
        df = df.offset(offset) if offset else df
        return df.limit(limit) if limit is not None else df

    def add_source(self, table: str, df: DataFrame) -> None:
        """A DataFrame under a name, to be read only."""
        self.sources[table] = df

    def function(self, fn_name: str, fn: Callable, returns: str, arity: int | None = None) -> None:
        """A scalar function of pandas Series for SQL; a wrong number of arguments is refused."""
        import inspect

        n = len(inspect.signature(fn).parameters)
        if arity is not None and arity != n:
            raise ValueError(f"{fn_name} takes {n} arguments, not {arity}")
        self.spark.udf.register(fn_name, F.pandas_udf(fn, returns))

    def aggregate(self, fn_name: str, fn: Callable, returns: str) -> None:
        """An aggregate: a function of a group's values (a pandas Series) to one value."""
        from pyspark.sql.functions import PandasUDFType

        self.spark.udf.register(fn_name, F.pandas_udf(fn, returns, PandasUDFType.GROUPED_AGG))

    def procedure(self, proc_name: str, fn: Callable) -> None:
        """A Python function (database, *arguments) to a DataFrame, for CALL."""
        self.procedures[proc_name] = fn

    def trigger(self, trigger_name: str, timing: str, event: str, table: str, fn: Callable) -> None:
        """fn(database, rows) to rows: before, it may change or refuse (raise) the rows to be written; after, what it returns is ignored."""
        self.triggers[trigger_name] = (timing.lower(), event.lower(), table, fn)

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows without checks or triggers."""
        self.lake(table).append(rows, self._branch(table))

    def _branch(self, table: str) -> str:
        return self._txn["branch"] if self._txn and table in self._txn["heads"] else "main"

    def _apply(self, table: str, gone: DataFrame | None, rows: DataFrame | None, operation: str, key: list[str] | None = None) -> None:
        """Take rows away and add others, in one version. With a key that writes delete keys and new rows only; without one the table is written anew."""
        t, lake, branch = self.tables[table], self.lake(table), self._branch(table)
        head, key = lake.head(branch), key or t.key
        if gone is None:
            lake.append(rows, branch, head)
        elif key:
            lake.change(gone, rows, key, branch, head, operation)
        else:
            left = lake._read(head)
            left = left.exceptAll(gone.select(*left.columns))
            lake.overwrite(durable(left if rows is None else left.unionByName(rows.select(*left.columns))), branch, operation, head)

    def _fire(self, timing: str, event: str, table: str, rows: DataFrame) -> DataFrame:
        for t, e, on, fn in list(self.triggers.values()):
            if (t, e, on) == (timing, event, table):
                got = fn(self, rows)
                rows = got if timing == "before" and got is not None else rows
        return rows

    def _has_trigger(self, timing: str, event: str, table: str) -> bool:
        return any((t.timing, t.event, t.table) == (timing, event, table) for t in self.sql_triggers.values())

    def _fire_sql(self, timing: str, event: str, table: str, pairs: DataFrame, sets=None) -> DataFrame:
        """Run the triggers in SQL, each statement once for all rows. pairs: rows with old_ and new_ columns; those that RAISE(IGNORE) spares are left out of the result."""
        for t in list(self.sql_triggers.values()):
            if (t.timing, t.event, t.table) != (timing, event, table) or (t.columns and sets is not None and not set(t.columns) & set(sets)):
                continue
            if self._depth > 16:
                raise RuntimeError("triggers set each other off more than 16 deep")
            kept, self.sources = self.sources, dict(self.sources)
            self._depth += 1
            try:
                pairs = durable(pairs.drop("__i").withColumn("__i", F.monotonically_increasing_id()))
                self.sources["mr_changed"] = pairs
                rows = durable(self._query([*lex("SELECT mr_changed.* FROM mr_changed WHERE "), *_told(lex(t.when))])) if t.when else pairs
                self.sources["mr_changed"] = rows
                if rows.limit(1).count():
                    for statement in t.body:
                        spared = self._trigger_statement(lex(statement))
                        if spared is not None:
                            pairs = pairs.join(spared.select("__i"), "__i", "left_anti")
            finally:
                self.sources = kept
                self._depth -= 1
        return pairs.drop("__i")

    def _trigger_statement(self, s: list[Token]) -> DataFrame | None:
        """Run a trigger's statement for the rows of mr_changed; of RAISE(IGNORE), the rows it means."""
        s = _told(s)
        word = next(t for t in s if t.kind != "space").text.upper()
        raises = next((i for i, t in enumerate(s) if t.is_("RAISE")), -1)
        where = find(s, "WHERE")
        if raises >= 0:
            args = [x for x in split(s[after(s, raises) + 1 : closing(s, after(s, raises))])]
            kind, message = solid(args[0])[0].text.upper(), solid(args[1])[0].text[1:-1].replace("''", "'") if len(args) > 1 else "refused"
            case, then = next((i for i, t in enumerate(s[:raises]) if t.is_("WHEN")), -1), next((i for i, t in enumerate(s[:raises]) if t.is_("THEN")), -1)
            cond = s[case + 1 : then] if case >= 0 else s[where + 1 :] if where >= 0 else lex("TRUE")
            hit = durable(self._query([*lex("SELECT mr_changed.* FROM mr_changed WHERE "), *cond]))
            if kind == "IGNORE":
                return hit
            if hit.limit(1).count():
                if kind == "ROLLBACK" and self._txn:
                    self._rollback(lex("ROLLBACK"))
                raise ConstraintError(message)
            return None
        if word in ("INSERT", "REPLACE"):
            v, q = find(s, "VALUES"), find(s, "SELECT")
            if v >= 0:
                rows = split(s[after(s, v) :])
                if len(rows) > 1:
                    for r in rows:
                        self.sql(text([*s[:v], *lex("VALUES "), *r]))
                    return None
                b = after(s, v)
                s = [*s[:v], *lex("SELECT "), *s[b + 1 : closing(s, b)], *lex(" FROM mr_changed"), *s[closing(s, b) + 1 :]]
            elif q >= 0 and any(t.text.startswith("mr_changed.") for t in s):
                f = find(s, "FROM", start=q)
                w = find(s, "WHERE", start=q)
                s = [*s[: f + 1], *lex(" mr_changed, "), *s[f + 1 :]] if f >= 0 else [*s[: w if w >= 0 else len(s)], *lex(" FROM mr_changed "), *(s[w:] if w >= 0 else [])]
        elif word == "UPDATE" and any(t.text.startswith("mr_changed.") for t in s):
            f = find(s, "FROM")
            s = [*s[: f + 1], *lex(" mr_changed, "), *s[f + 1 :]] if f >= 0 else [*s[: where if where >= 0 else len(s)], *lex(" FROM mr_changed "), *(s[where:] if where >= 0 else lex(" WHERE TRUE"))]
        elif word == "DELETE" and any(t.text.startswith("mr_changed.") for t in s):
            s = [*s[: where + 1], *lex(" EXISTS (SELECT 1 FROM mr_changed WHERE "), *s[where + 1 :], *lex(")")]
        self.sql(text(s))
        return None

    # Queries

    def sql(self, statement: str, params=None) -> DataFrame:
        tokens = lex(statement.strip().rstrip(";"))
        s = solid(tokens)
        if not s:
            raise ValueError("an empty statement")
        word = s[0].text.upper()
        if self.read_only and word in ("INSERT", "REPLACE", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER", "MERGE", "REFRESH"):
            raise PermissionError("the database is read only")
        do = getattr(self, f"_{word.lower()}", None) if word not in ("SELECT", "WITH", "VALUES") else None
        if do is None:
            return self._query(tokens, params)
        if word in ("INSERT", "REPLACE", "UPDATE", "DELETE") and params is not None:
            tokens = self._inline(statement, params)
        return do(tokens)

    def _inline(self, statement: str, params) -> list[Token]:
        from .dialect import parameters

        toks, names = parameters(lex(statement.strip().rstrip(";")))
        given = bind(names, params)
        lit = lambda v: "NULL" if v is None else ("TRUE" if v else "FALSE") if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
        return [Token("string" if isinstance(given[t.text[1:]], str) else "raw", lit(given[t.text[1:]])) if t.kind == "param" else t for t in toks]

    def _fixpoint(self, tokens: list[Token]) -> tuple[list[Token], str, DataFrame] | None:
        """(the rest of the statement, name, rows) of WITH RECURSIVE name AS (seed UNION step) ..., which Spark can't read; None for others."""
        s = solid(tokens)
        if len(s) < 4 or not (s[0].is_("WITH") and s[1].is_("RECURSIVE")):
            return None
        at = tokens.index(s[2])
        a = after(tokens, at)
        cols = None
        if tokens[a].text == "(":
            cols = [name(solid(x)[0]) for x in split(tokens[a + 1 : closing(tokens, a)])]
            a = after(tokens, closing(tokens, a))
        b = after(tokens, a)
        body = tokens[b + 1 : closing(tokens, b)]
        u = find(body, "UNION")
        rest = after(tokens, closing(tokens, b))
        if u < 0 or body[after(body, u)].is_("ALL") or tokens[rest].text == ",":
            return None
        cte = name(s[2])
        seed = self._query(body[:u])
        cols = cols or seed.columns
        hidden = {k: self.__dict__[k] for k in ("sources",)}

        def step(new: DataFrame) -> DataFrame:
            self.sources = hidden["sources"] | {cte: new}
            try:
                return self._query(body[u + 1 :])
            finally:
                self.sources = hidden["sources"]

        return tokens[rest:], cte, recursive_distinct(seed.toDF(*cols), step)

    def _query(self, tokens: list[Token], params=None) -> DataFrame:
        if fix := self._fixpoint(tokens):
            kept, self.sources = self.sources, self.sources | {fix[1]: fix[2]}
            try:
                return self._query(fix[0], params)
            finally:
                self.sources = kept
        out, views, i, prev = [], {}, 0, None
        ctes = {name(tokens[k]) for k in range(len(tokens)) if tokens[k].kind == "word" and (a := after(tokens, k)) < len(tokens) and tokens[a].is_("AS") and (b := after(tokens, a)) < len(tokens) and tokens[b].text == "("}
        depth_from = [False]
        while i < len(tokens):
            t = tokens[i]
            if t.text == "(":
                depth_from.append(False)
            elif t.text == ")":
                depth_from.pop()
            elif t.is_("FROM", "JOIN"):
                depth_from[-1] = True
            elif t.is_("WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "SELECT", "ON", "USING", "WINDOW", "SET"):
                depth_from[-1] = False
            starts = prev is not None and (prev.is_("FROM", "JOIN") or prev.text == "," and depth_from[-1])
            if starts and t.kind in ("word", "quoted", "string") and not t.is_("LATERAL", "SELECT", "VALUES"):
                made, i2 = self._relation(tokens, i, ctes)
                if made is not None:
                    v = f"mr_{len(views)}_{abs(hash((self.path, i, len(tokens)))) % 10**8}"
                    views[v] = made[0]
                    a = after(tokens, i2)
                    alias = a < len(tokens) and (tokens[a].is_("AS") or tokens[a].kind == "quoted" or (tokens[a].kind == "word" and not tokens[a].is_("WHERE", "JOIN", "ON", "GROUP", "ORDER", "LEFT", "RIGHT", "INNER", "FULL", "CROSS", "NATURAL", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "HAVING", "USING", "WINDOW", "LATERAL", "OFFSET", "SET")))
                    out.append(Token("raw", v if alias else f"{v} AS `{made[1]}`"))
                    prev, i = Token("word", "x"), i2 + 1
                    continue
            out.append(t)
            prev = t if t.kind != "space" else prev
            i += 1
        for v, df in views.items():
            df.createOrReplaceTempView(v)
        sql, names = _translate_tokens(out)
        df = self.spark.sql(sql, args=bind(names, params)) if names else self.spark.sql(sql)
        for v in views:
            self.spark.catalog.dropTempView(v)
        return df

    def _relation(self, tokens: list[Token], i: int, ctes: set[str]):
        """((rows, name), last token) of the table reference at i, or (None, i) if it is somebody else's."""
        t = tokens[i]
        k = after(tokens, i)
        if t.kind == "string" or t.is_("URL") and k < len(tokens) and tokens[k].text == "(":
            end, args = i, [t]
            if t.kind != "string":
                end = closing(tokens, k)
                args = [solid(x)[0] for x in split(tokens[k + 1 : end])]
            options, w = {}, after(tokens, end)
            if w < len(tokens) and tokens[w].is_("WITH") and tokens[after(tokens, w)].text == "(":
                o = after(tokens, w)
                end = closing(tokens, o)
                for part in split(tokens[o + 1 : end]):
                    p = [x for x in solid(part) if x.text != "="]
                    options[p[0].text.lower()] = p[1].text.strip("'")
            uri, fmt = args[0].text[1:-1], args[1].text.strip("'") if len(args) > 1 else options.pop("format", None)
            return (open_source(self.spark, uri, fmt, **options), "source"), end
        full, end = table_of(tokens, i)
        if full in ctes or tokens[min(after(tokens, end), len(tokens) - 1)].text == "(" and after(tokens, end) < len(tokens):
            return None, i
        db, short = self._where(full) if full.split(".")[0] in (*self.attached, "main") or "." not in full else (self, full)
        if short not in db.tables and short not in db.views and short not in db.sources:
            return None, i
        k = after(tokens, end)
        how: dict = {}
        if k < len(tokens) and tokens[k].is_("FOR"):
            s = after(tokens, k)
            if s < len(tokens) and tokens[s].is_("SYSTEM_TIME"):
                a = after(tokens, s)
                if tokens[a].is_("AS"):
                    v = after(tokens, after(tokens, a))
                    if tokens[v].is_("TIMESTAMP"):
                        v = after(tokens, v)
                    return (db.lake(short).read(timestamp=tokens[v].text.strip("'")), short), v
                lo = after(tokens, a)
                hi = after(tokens, after(tokens, lo))
                return (db.lake(short).between(tokens[lo].text.strip("'"), tokens[hi].text.strip("'")), short), hi
        if k < len(tokens) and tokens[k].is_("AS") and tokens[min(after(tokens, k), len(tokens) - 1)].is_("OF"):
            kind = after(tokens, after(tokens, k))
            v = after(tokens, kind)
            if tokens[kind].is_("SYSTEM") or tokens[v].is_("TIME"):
                v = after(tokens, v)
            value = name(tokens[v]) if tokens[v].kind != "string" else tokens[v].text[1:-1]
            what = tokens[kind].text.upper()
            how = {"BRANCH": {"branch": value}, "TIMESTAMP": {"timestamp": value}, "SYSTEM": {"timestamp": value}}.get(what, {"version": value})
            end = v
        return (db.table(short, **how), short), end

    # Changes

    def _done(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "changes bigint")

    def _returning(self, tokens: list[Token], rows: DataFrame) -> DataFrame:
        """The affected rows, as RETURNING asks for them, or their number."""
        at = find(tokens, "RETURNING")
        rows = durable(rows)
        if at < 0:
            return self._done(rows.count())
        items = text(tokens[at + 1 :]).strip()
        return rows.selectExpr(*[translate(text(x).strip())[0] for x in split(lex(items))]) if items != "*" else rows

    def _rules(self, t: Table) -> dict:
        """Of each row rule when it is broken."""
        return {f"NOT NULL {c}": F.col(c).isNull() for c in dict.fromkeys([*t.not_null, *t.key])} | {f"CHECK ({c})": F.expr(translate(f"NOT ({c})")[0]) for c in t.checks}

    def _clashing(self, rows: DataFrame, others: DataFrame | None, cols: list[str]) -> DataFrame:
        """Values of cols that stand more than once in rows, or in rows and others; only those of others that rows have are counted."""
        both = rows.select(*cols)
        if others is not None:
            both = both.unionByName(others.select(*cols).join(rows.select(*cols).distinct(), cols, "left_semi"))
        return self.duplicates(both, cols)

    def check(self, table: str, rows: DataFrame, others: DataFrame | None = None, uniques: list[list[str]] | None = None) -> None:
        """ConstraintError if rows, beside the other rows of the table, break a constraint. All row rules are counted in one pass."""
        t = self.tables[table]
        rules = self._rules(t)
        if rules:
            n = rows.agg(*[F.count(F.when(bad, 1)).alias(f"r{i}") for i, bad in enumerate(rules.values())]).first()
            for i, rule in enumerate(rules):
                if n[i]:
                    raise ConstraintError(f"{rule} of {table}: {n[i]} rows")
        for cols in t.changed_uniques([c for c, _ in t.columns]) if uniques is None else uniques:
            if self._clashing(rows, others, cols).limit(1).count():
                raise ConstraintError(f"UNIQUE ({', '.join(cols)}) of {table}")
        for cols, other, theirs, *_ in t.foreign:
            if orphans(rows, self.table(other), cols, theirs).limit(1).count():
                raise ConstraintError(f"FOREIGN KEY ({', '.join(cols)}) of {table} to {other}")

    @staticmethod
    def duplicates(rows: DataFrame, cols: list[str]) -> DataFrame:
        """Values of cols that stand more than once; nulls are never equal."""
        return rows.where(" and ".join(f"`{c}` is not null" for c in cols)).groupBy(*cols).count().where("count > 1")

    def _columns(self, t: Table) -> dict[str, str]:
        return dict(t.columns)

    def _fitted(self, t: Table, rows: DataFrame, beside: list[str] | None = None) -> DataFrame:
        """rows in the table's columns, with defaults and generated values, and columns beside them."""
        kinds, beside = self._columns(t), beside or []
        rows = rows.select(*beside, *[(F.col(f"`{c}`") if c in rows.columns else F.expr(t.defaults.get(c, "NULL"))).cast(k).alias(c) for c, k in kinds.items() if c not in t.generated])
        for c, e in t.generated.items():
            rows = rows.withColumn(c, F.expr(e).cast(kinds[c]))
        return rows.select(*beside, *kinds)

    def _replace(self, tokens: list[Token]) -> DataFrame:
        return self._insert(tokens, "REPLACE")

    def _insert(self, tokens: list[Token], clash: str = "ABORT") -> DataFrame:
        s = tokens
        into = find(s, "INTO")
        o = find(s, "OR")
        if 0 <= o < into:
            clash = s[after(s, o)].text.upper()
        table, end = table_of(s, after(s, into))
        db, table = self._where(table)
        view = db.views.get(table) if table not in db.tables else None
        base = db._base(table) if view and not db._has_trigger("instead of", "insert", table) else None
        t = db.tables[base[0] if base else table] if base or not view else Table(table, [(f.name, f.dataType.simpleString()) for f in db.sql(view).schema.fields])
        k = after(s, end)
        cols = None
        if k < len(s) and s[k].text == "(":
            close = closing(s, k)
            cols = [name(solid(x)[0]) for x in split(s[k + 1 : close])]
            k = after(s, close)
        conflict, ret = find(s, "CONFLICT", start=k), find(s, "RETURNING", start=k)
        stop = min(x for x in (len(s), ret if ret >= 0 else len(s), _back(s, conflict, "ON") if conflict >= 0 else len(s)))
        if s[k].is_("DEFAULT"):
            rows = self.spark.createDataFrame([(1,)], "__x int")
        else:
            src = self._query([*lex("SELECT * FROM ("), *s[k:stop], *lex(") AS mr_values")] if s[k].is_("VALUES") else s[k:stop])
            names = cols or [c for c, _ in t.columns if c not in t.generated]
            if len(names) != len(src.columns):
                raise ValueError(f"{len(src.columns)} values for {len(names)} columns")
            rows = src.toDF(*names)
        if view and not base:
            if not db._has_trigger("instead of", "insert", table):
                raise ValueError(f"the view {table} picks no rows of one table and has no INSTEAD OF INSERT trigger")
            pairs = db._fire_sql("instead of", "insert", table, _prefixed(self._fitted(t, rows), "new_"))
            return self._returning(s, _unprefixed(pairs, "new_"))
        if base:
            if base[1] and table in db.checked_views and rows.where(f"NOT coalesce({translate(base[1])[0]}, FALSE)").limit(1).count():
                raise ConstraintError(f"CHECK OPTION of {table}")
            table = base[0]
        rows = durable(db._fire("before", "insert", table, self._fitted(t, rows)))
        if db._has_trigger("before", "insert", table):
            rows = durable(_unprefixed(db._fire_sql("before", "insert", table, _prefixed(rows, "new_")), "new_"))
        now = db.table(table)
        key = t.key or (t.unique[0] if t.unique else [])
        if conflict >= 0:
            b = after(s, conflict)
            if s[b].text == "(":
                key = [name(solid(x)[0]) for x in split(s[b + 1 : closing(s, b)])]
                b = after(s, closing(s, b))
            clash = "IGNORE" if find(s, "NOTHING", start=b) >= 0 else "UPSERT"
        affected = rows
        try:
            if clash in ("IGNORE", "REPLACE", "UPSERT") and key:
                # Of several rows of one key the first (IGNORE) or the last is meant; rows have no order, so the least or greatest is taken.
                if clash == "IGNORE":
                    rows = db._lawful(t, rows)
                pick = (F.min if clash == "IGNORE" else F.max)(F.struct(*[c for c in rows.columns if c not in key]))
                if len(rows.columns) > len(key):
                    rows = rows.groupBy(*key).agg(pick.alias("__r")).select(*key, "__r.*").select(*now.columns)
                if clash == "IGNORE":
                    affected = durable(rows.join(now.select(*key), key, "left_anti").select(*now.columns))
                    gone, left = None, now
                elif clash == "REPLACE":
                    affected = durable(rows)
                    gone, left = rows.select(*key), now.join(rows.select(*key), key, "left_anti")
                else:
                    changed, fresh = db._upserted(s, conflict, now, rows, key)
                    gone, affected = changed.select(*key), durable(changed.unionByName(fresh))
                    left = now.join(gone, key, "left_anti")
                db.check(table, affected, left)
                db._apply(table, gone, affected, clash.lower(), key)
            else:
                if clash == "FAIL":
                    affected = durable(db._lawful(t, rows, now))
                    db._apply(table, None, affected, "insert")
                    db.check(table, rows.exceptAll(affected), now, t.changed_uniques(now.columns))
                    if rows.exceptAll(affected).limit(1).count():
                        raise ConstraintError(f"some rows of {table} break a constraint; the others are written")
                else:
                    db.check(table, rows, now if key or t.unique else None)
                    db._apply(table, None, rows, "insert")
        except ConstraintError:
            if clash == "ROLLBACK" and db._txn:
                db._rollback(lex("ROLLBACK"))
            raise
        db._fire("after", "insert", table, affected)
        if db._has_trigger("after", "insert", table):
            db._fire_sql("after", "insert", table, _prefixed(affected, "new_"))
        return self._returning(s, affected)

    def _lawful(self, t: Table, rows: DataFrame, now: DataFrame | None = None) -> DataFrame:
        """rows that break no row rule and, where now is given, no key (of several of one key the least)."""
        for bad in self._rules(t).values():
            rows = rows.where(~F.coalesce(bad, F.lit(False)))
        for cols in t.changed_uniques(rows.columns) if now is not None else []:
            rest = [c for c in rows.columns if c not in cols]
            order = rows.columns
            rows = rows.join(now.select(*cols), cols, "left_anti")
            rows = (rows.groupBy(*cols).agg(F.min(F.struct(*rest)).alias("__r")).select(*cols, "__r.*") if rest else rows.distinct()).select(*order)
        return rows

    def _base(self, view: str) -> tuple[str, str | None] | None:
        """(table, condition) of a view that only picks rows of one table, to which rows can be added; None of others."""
        s = lex(self.views[view])
        f = find(s, "FROM")
        if f < 0 or find(s, "GROUP", "JOIN", "UNION", "DISTINCT", "LIMIT", "HAVING", "INTERSECT", "EXCEPT") >= 0 or any(t.text == "(" for t in s[:f]):
            return None
        table, end = table_of(s, after(s, f))
        w = find(s, "WHERE")
        return (table, text(s[w + 1 :]).strip() if w >= 0 else None) if table in self.tables and (after(s, end) >= len(s) or after(s, end) == w) else None

    def _upserted(self, s: list[Token], conflict: int, now: DataFrame, rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
        """(rows of the table that change, as they will be; rows that are new)."""
        at = find(s, "SET", start=conflict)
        w = find(s, "WHERE", start=at)
        ret = find(s, "RETURNING", start=at)
        end = min(x for x in (len(s), w if w >= 0 else len(s), ret if ret >= 0 else len(s)))
        sets = _assignments(s[at + 1 : end])
        cond = text(s[w + 1 : ret if ret >= 0 else len(s)]).strip() if w >= 0 else None
        j = now.alias("mr_t").join(rows.alias("excluded"), [F.col(f"mr_t.{c}") == F.col(f"excluded.{c}") for c in key])
        if cond:
            j = j.where(F.expr(translate(_qualified(cond, now.columns))[0]))
        changed = j.select(*[(F.expr(translate(_qualified(sets[c], now.columns))[0]).cast(now.schema[c].dataType) if c in sets else F.col(f"mr_t.{c}")).alias(c) for c in now.columns])
        fresh = rows.join(now.select(*key), key, "left_anti").select(*now.columns)
        return durable(changed), durable(fresh)

    def _clauses(self, s: list[Token], start: int) -> tuple[str, str | None, str | None]:
        """(WHERE, ORDER BY, LIMIT) from start on."""
        marks = {w: find(s, w, start=start) for w in ("WHERE", "ORDER", "LIMIT", "RETURNING")}
        cut = lambda w: next((marks[x] for x in ("ORDER", "LIMIT", "RETURNING") if marks[x] > marks[w]), len(s))
        where = text(s[marks["WHERE"] + 1 : cut("WHERE")]).strip() if marks["WHERE"] >= 0 else "TRUE"
        order = text(s[after(s, marks["ORDER"]) + 1 : min(x for x in (marks["LIMIT"], marks["RETURNING"], len(s)) if x > 0)]).strip() if marks["ORDER"] >= 0 else None
        limit = text(s[marks["LIMIT"] + 1 : marks["RETURNING"] if marks["RETURNING"] > 0 else len(s)]).strip() if marks["LIMIT"] >= 0 else None
        return where, order, limit

    def _meant(self, table: str, items: str, where: str, order: str | None, limit: str | None) -> DataFrame:
        """items of the rows a change means. A limit takes the first rows in the order, each task's first ones first."""
        q = f"SELECT {items} FROM {table} WHERE {where}" + (f" ORDER BY {order}" if order else "") + (f" LIMIT {limit}" if limit else "")
        return durable(self._query(lex(q)))

    def _update(self, s: list[Token]) -> DataFrame:
        table, end = table_of(s, after(s, 0))
        db, short = self._where(table)
        view = db.views.get(short) if short not in db.tables else None
        t = db.tables[short] if not view else Table(short, [(f.name, f.dataType.simpleString()) for f in db.sql(view).schema.fields])
        at = find(s, "SET")
        src = find(s, "FROM", start=at)
        where, order, limit = self._clauses(s, at)
        stop = min(x for x in (src, find(s, "WHERE", start=at), find(s, "ORDER", start=at), find(s, "LIMIT", start=at), find(s, "RETURNING", start=at), len(s)) if x >= 0)
        sets = _assignments(s[at + 1 : stop])
        cols = [c for c, _ in t.columns]
        items = ", ".join([f"{short}.`{c}` AS `old_{c}`" for c in cols] + [f"({e}) AS `__s{i}`" for i, e in enumerate(sets.values())])
        if src >= 0:
            fend = min(x for x in (find(s, "WHERE", start=src), find(s, "RETURNING", start=src), len(s)) if x >= 0)
            pairs = self._query(lex(f"SELECT {items} FROM {table}, {text(s[src + 1 : fend]).strip()} WHERE {where}"))
            old = [f"old_{c}" for c in (t.key or cols)]
            rest = [c for c in pairs.columns if c not in old]
            pairs = durable(pairs.groupBy(*old).agg(F.min(F.struct(*rest)).alias("__r")).select(*old, "__r.*"))
        else:
            pairs = self._meant(table, items, where, order, limit)
        new = [F.col(f"__s{list(sets).index(c)}").alias(c) if c in sets else F.col(f"old_{c}").alias(c) for c in cols]
        pairs = self._fitted(t, pairs.select(*[f"old_{c}" for c in cols], *new), [f"old_{c}" for c in cols])
        both = lambda p: p.select(*[f"old_{c}" for c in cols], *[F.col(c).alias(f"new_{c}") for c in cols])
        if view:
            if not db._has_trigger("instead of", "update", short):
                raise ValueError(f"the view {short} has no INSTEAD OF UPDATE trigger")
            return self._returning(s, _unprefixed(db._fire_sql("instead of", "update", short, both(pairs), sets), "new_"))
        pairs = durable(pairs)
        if db._has_trigger("before", "update", short):
            kept = durable(db._fire_sql("before", "update", short, both(pairs), sets))
            pairs = kept.select(*[f"old_{c}" for c in cols], *[F.col(f"new_{c}").alias(c) for c in cols])
        hit = durable(db._fire("before", "update", short, pairs.select(*cols)))
        gone = _unprefixed(pairs, "old_")
        uniques = t.changed_uniques(sets)
        now = db.table(short)
        left = None if not uniques else now.join(gone.select(*t.key), t.key, "left_anti") if t.key else now.exceptAll(gone.select(*now.columns))
        db.check(short, hit, left, uniques)
        db._parents_changed(short, pairs, sets)
        db._apply(short, gone, hit, "update")
        db._fire("after", "update", short, hit)
        if db._has_trigger("after", "update", short):
            db._fire_sql("after", "update", short, both(pairs), sets)
        return self._returning(s, hit)

    def _children(self, table: str):
        """(child, its columns, the table's columns, ON DELETE, ON UPDATE) of every foreign key to a table."""
        return [(c.name, cols, theirs, delete, update) for c in self.tables.values() for cols, other, theirs, delete, update in c.foreign if other == table]

    def _with_action(self, child: str, cols: list[str], theirs: list[str], action: str, gone: DataFrame, new: list | None = None) -> None:
        """What becomes of the children of rows that go (new: or get other values)."""
        keys = gone.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(theirs)], *(x.alias(f"__n{i}") for i, x in enumerate(new or [])))
        mine = self.table(child)
        hit = durable(mine.join(keys, [F.col(c) == F.col(f"__p{i}") for i, c in enumerate(cols)]))
        if not hit.limit(1).count():
            return
        if action in ("RESTRICT", "NO ACTION"):
            raise ConstraintError(f"rows of {child} refer to rows that go")
        old = hit.select(*mine.columns)
        if action == "CASCADE" and new is None:
            self._drop_rows(child, old)
            return
        t = self.tables[child]
        value = {c: F.col(f"__n{i}") if action == "CASCADE" else F.expr(t.defaults.get(c, "NULL")) if action == "SET DEFAULT" else F.lit(None) for i, c in enumerate(cols)}
        self._apply(child, old, self._fitted(t, hit.select(*[value.get(c, F.col(c)).alias(c) for c in mine.columns])), "cascade")

    def _parents_changed(self, table: str, pairs: DataFrame, sets) -> None:
        for child, cols, theirs, _, action in self._children(table):
            if set(theirs) & set(sets) and (action != "NO ACTION" or self.foreign_keys):
                other = pairs.where(" or ".join(f"NOT (`old_{c}` <=> `{c}`)" for c in theirs))
                self._with_action(child, cols, [f"old_{c}" for c in theirs], action, other, [F.col(c) for c in theirs])

    def _drop_rows(self, table: str, rows: DataFrame) -> None:
        """Delete rows, and what their children's ON DELETE says."""
        for child, cols, theirs, action, _ in self._children(table):
            if action != "NO ACTION" or self.foreign_keys:
                self._with_action(child, cols, theirs, action, rows)
        self._apply(table, rows, None, "delete")

    def _delete(self, s: list[Token]) -> DataFrame:
        f = find(s, "FROM")
        table, end = table_of(s, after(s, f))
        db, short = self._where(table)
        gone = self._meant(table, f"{short}.*", *self._clauses(s, end))
        if short not in db.tables:
            if not db._has_trigger("instead of", "delete", short):
                raise ValueError(f"the view {short} has no INSTEAD OF DELETE trigger")
            return self._returning(s, _unprefixed(db._fire_sql("instead of", "delete", short, _prefixed(gone, "old_")), "old_"))
        gone = db._fire("before", "delete", short, gone)
        if db._has_trigger("before", "delete", short):
            gone = durable(_unprefixed(db._fire_sql("before", "delete", short, _prefixed(gone, "old_")), "old_"))
        db._drop_rows(short, gone)
        db._fire("after", "delete", short, gone)
        if db._has_trigger("after", "delete", short):
            db._fire_sql("after", "delete", short, _prefixed(gone, "old_"))
        return self._returning(s, gone)

    # Definitions

    def _create(self, s: list[Token]) -> DataFrame:
        done = self._create_trigger(s) if any(t.is_("TRIGGER") for t in solid(s)[:3]) else self._create_other(s)
        self._save()
        return done

    def _create_trigger(self, s: list[Token]) -> DataFrame:
        k = after(s, find(s, "TRIGGER"))
        quiet = s[k].is_("IF")
        k = after(s, after(s, after(s, k))) if quiet else k
        trigger = name(s[k])
        if trigger in self.sql_triggers:
            if quiet:
                return self._done(0)
            raise ValueError(f"there is a trigger {trigger}")
        on, begin, when = find(s, "ON", start=k), find(s, "BEGIN", start=k), find(s, "WHEN", start=k)
        if begin < 0 or not solid(s)[-1].is_("END"):
            raise ValueError("a trigger needs BEGIN ... END")
        head = solid(s[k + 1 : on])
        timing = head[0].text.lower() if head[0].is_("BEFORE", "AFTER") else "instead of" if head[0].is_("INSTEAD") else "before"
        event = next(t for t in head if t.is_("INSERT", "UPDATE", "DELETE"))
        of = [name(t) for t in head[head.index(event) + 1 :] if t.text not in (",",) and not t.is_("OF")]
        table, _ = table_of(s, after(s, on))
        if table not in self.tables and table not in self.views:
            raise LookupError(f"no table {table}")
        if (timing == "instead of") != (table not in self.tables):
            raise ValueError("INSTEAD OF triggers are for views, others for tables")
        last = max(i for i, t in enumerate(s) if t.is_("END"))
        body = [text(x).strip() for x in split(s[begin + 1 : last], ";") if solid(x)]
        self.sql_triggers[trigger] = Trigger(trigger, timing, event.text.lower(), table, of, text(s[when + 1 : begin]).strip() if 0 <= when < begin else None, body)
        return self._done(0)

    def _create_other(self, s: list[Token]) -> DataFrame:
        what = next(i for i, t in enumerate(s) if t.is_("TABLE", "VIEW", "INDEX"))
        k = after(s, what)
        skip = s[k].is_("IF")
        if skip:
            k = after(s, after(s, after(s, k)))
        table, end = table_of(s, k)
        if s[what].is_("VIEW"):
            a = find(s, "AS", start=end)
            if table in self.tables or table in self.views and not skip:
                raise ValueError(f"there is a {table}")
            if any(t.is_("MATERIALIZED") for t in s[:what]):
                return self._materialize(table, s[a + 1 :])
            option = next((i for i in range(a, len(s)) if s[i].is_("WITH") and [t.text.upper() for t in solid(s[i:])][-2:] == ["CHECK", "OPTION"] and len(solid(s[i:])) <= 4), -1)
            if option >= 0:
                self.checked_views.append(table)
            self.views.setdefault(table, text(s[a + 1 : option if option >= 0 else len(s)]).strip())
            return self._done(0)
        if s[what].is_("INDEX"):
            on, _ = table_of(s, after(s, find(s, "ON", start=end)))
            b = next(i for i in range(end, len(s)) if s[i].text == "(")
            cols = [name(solid(x)[0]) for x in split(s[b + 1 : closing(s, b)])]
            self.tables[on].indexes[table] = cols
            if any(t.is_("UNIQUE") for t in s[:what]):
                if self.duplicates(self.table(on), cols).limit(1).count():
                    raise ConstraintError(f"{table}: duplicate values")
                self.tables[on].unique.append(cols)
            return self._done(0)
        if table in self.tables:
            if skip:
                return self._done(0)
            raise ValueError(f"there is a table {table}")
        k = after(s, end)
        if s[k].is_("AS"):
            rows = durable(self._query(s[k + 1 :]))
            t = Table(table, [(f.name, f.dataType.simpleString()) for f in rows.schema.fields])
            LakeTable.create(self.spark, f"{self.path}/{table}", rows.schema).append(rows)
            self.tables[table] = t
            return self._done(rows.count())
        t = self._table(table, split(s[k + 1 : closing(s, k)]))
        LakeTable.create(self.spark, f"{self.path}/{table}", ", ".join(f"`{c}` {kind}" for c, kind in t.columns))
        self.tables[table] = t
        return self._done(0)

    def _materialize(self, view: str, query: list[Token]) -> DataFrame:
        """A view whose rows are stored, as they are now; REFRESH MATERIALIZED VIEW stores them anew."""
        rows = durable(self._query(query))
        LakeTable.create(self.spark, f"{self.path}/{view}", rows.schema).append(rows)
        self.tables[view] = Table(view, [(f.name, f.dataType.simpleString()) for f in rows.schema.fields])
        self.materialized[view] = text(query).strip()
        return self._done(rows.count())

    def _refresh(self, s: list[Token]) -> DataFrame:
        view = name(solid(s)[-1])
        if view not in self.materialized:
            raise LookupError(f"no materialized view {view}")
        rows = durable(self._query(lex(self.materialized[view])))
        self.lake(view).overwrite(rows, self._branch(view), "refresh")
        return self._done(rows.count())

    def _table(self, table: str, parts: list[list[Token]]) -> Table:
        t = Table(table, [])
        in_brackets = lambda p, i: [name(solid(x)[0]) for x in split(p[i + 1 : closing(p, i)])]
        words = ("PRIMARY", "NOT", "NULL", "UNIQUE", "CHECK", "DEFAULT", "REFERENCES", "GENERATED", "AS", "COLLATE", "CONSTRAINT")
        for p in parts:
            p = p[after(p, -1) :]
            head = p[after(p, after(p, 0))] if p[0].is_("CONSTRAINT") else p[0]
            if head.is_("PRIMARY", "UNIQUE", "CHECK", "FOREIGN"):
                b = next(i for i, x in enumerate(p) if x.text == "(")
                if head.is_("CHECK"):
                    t.checks.append(text(p[b + 1 : closing(p, b)]).strip())
                elif head.is_("PRIMARY"):
                    t.key = in_brackets(p, b)
                elif head.is_("UNIQUE"):
                    t.unique.append(in_brackets(p, b))
                else:
                    other, e = table_of(p, after(p, find(p, "REFERENCES")))
                    o = after(p, e)
                    t.foreign.append((in_brackets(p, b), other, in_brackets(p, o) if o < len(p) and p[o].text == "(" else self.tables[other].key, _action(p, "DELETE"), _action(p, "UPDATE")))
                continue
            col = name(p[0])
            stop = find(p, *words)
            stop = len(p) if stop < 0 else stop
            t.columns.append((col, _spark_type(p[1:stop])))
            i = stop
            while i < len(p):
                if p[i].is_("PRIMARY"):
                    t.key = [col]
                elif p[i].is_("NOT"):
                    t.not_null.append(col)
                elif p[i].is_("UNIQUE"):
                    t.unique.append([col])
                elif p[i].is_("CHECK") or p[i].is_("AS"):
                    b = after(p, i)
                    e = text(p[b + 1 : closing(p, b)]).strip()
                    if p[i].is_("AS"):
                        t.generated[col] = translate(e)[0]
                    else:
                        t.checks.append(e)
                    i = closing(p, b)
                elif p[i].is_("DEFAULT"):
                    b = after(p, i)
                    e = closing(p, b) if p[b].text == "(" else after(p, b) if p[b].text == "-" else b
                    t.defaults[col] = translate(text(p[b : e + 1]))[0]
                    i = e
                elif p[i].is_("REFERENCES"):
                    other, e = table_of(p, after(p, i))
                    b = after(p, e)
                    named = b < len(p) and p[b].text == "("
                    t.foreign.append(([col], other, in_brackets(p, b) if named else self.tables[other].key, _action(p, "DELETE"), _action(p, "UPDATE")))
                    i = len(p) if find(p, "ON") >= 0 else closing(p, b) if named else e
                i += 1
        return t

    def _drop(self, s: list[Token]) -> DataFrame:
        s = [t for t in s if not t.is_("MATERIALIZED")]
        what = after(s, 0)
        k = after(s, what)
        quiet = s[k].is_("IF")
        k = after(s, after(s, k)) if quiet else k
        obj, _ = table_of(s, k)
        if s[what].is_("TRIGGER"):
            if self.sql_triggers.pop(obj, None) is None and self.triggers.pop(obj, None) is None and not quiet:
                raise LookupError(f"no trigger {obj}")
        elif s[what].is_("TABLE") or obj in self.materialized:
            self.materialized.pop(obj, None)
            used = [v for v, q in self.views.items() if re.search(rf"\b{re.escape(obj)}\b", q)]
            if used:
                raise ValueError(f"views use {obj}: {', '.join(used)}")
            if self.tables.pop(obj, None) is None and not quiet:
                raise LookupError(f"no table {obj}")
            files.remove(self.spark, f"{self.path}/{obj}")
            self.sql_triggers = {k: t for k, t in self.sql_triggers.items() if t.table != obj}
        elif s[what].is_("VIEW"):
            if self.views.pop(obj, None) is None and not quiet:
                raise LookupError(f"no view {obj}")
        else:
            hit = [t for t in self.tables.values() if obj in t.indexes]
            if not hit and not quiet:
                raise LookupError(f"no index {obj}")
            for t in hit:
                del t.indexes[obj]
        self._save()
        return self._done(0)

    def _alter(self, s: list[Token]) -> DataFrame:
        table, end = table_of(s, after(s, after(s, 0)))
        t, lake, rest = self.tables[table], self.lake(table), [x for x in solid(s[end + 1 :]) if not x.is_("COLUMN")]
        if rest[0].is_("ADD"):
            part = s[find(s, "ADD") + 1 :]
            part = part[after(part, -1) :]
            part = part[after(part, 0) :] if part[0].is_("COLUMN") else part
            new = self._table(table, [part])
            col, kind = new.columns[0]
            default = self.spark.sql(f"SELECT {new.defaults[col]}").first()[0] if col in new.defaults else None
            if col in new.not_null and default is None:
                raise ConstraintError(f"a NOT NULL column {col} needs a default")
            lake.alter(add={col: kind}, defaults={col: default} if default is not None else None)
            t.columns.append((col, kind))
            t.not_null += new.not_null
            t.checks += new.checks
            t.defaults |= new.defaults
        elif rest[0].is_("DROP"):
            col = name(rest[1])
            lake.alter(drop=[col])
            t.columns = [(c, k) for c, k in t.columns if c != col]
        elif rest[0].is_("RENAME") and rest[1].is_("TO"):
            fs, at = files.fs_of(self.spark, f"{self.path}/{table}")
            fs.rename(at, self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name(rest[2])}"))
            self.tables[name(rest[2])] = self.tables.pop(table)
            self.tables[name(rest[2])].name = name(rest[2])
        else:
            old, new_name = name(rest[1]), name(rest[3])
            lake.alter(rename={old: new_name})
            sub = lambda xs: [new_name if x == old else x for x in xs]
            t.columns = [(new_name if c == old else c, k) for c, k in t.columns]
            t.key, t.not_null, t.unique = sub(t.key), sub(t.not_null), [sub(u) for u in t.unique]
        self._save()
        return self._done(0)

    # Transactions: a branch of every table that nobody else reads

    def _begin(self, s) -> DataFrame:
        if self._txn:
            raise ValueError("a transaction is open already")
        branch, heads = f"txn-{uuid.uuid4().hex}", {}
        for t in self.tables:
            lake = self.lake(t)
            heads[t] = lake.head()["id"]
            lake.branch(branch)
        self._txn = {"branch": branch, "heads": heads, "points": []}
        return self._done(0)

    def _savepoint(self, s) -> DataFrame:
        if not self._txn:
            self._begin(s)
        self._txn["points"].append((name(solid(s)[1]), {t: self.lake(t).head(self._branch(t))["lsn"] for t in self._txn["heads"] if t in self.tables}))
        return self._done(0)

    def _close(self) -> None:
        txn, self._txn = self._txn, None
        for t in txn["heads"]:
            if t in self.tables:
                self.lake(t).drop_branch(txn["branch"])

    def _commit(self, s) -> DataFrame:
        """Move the tables that were written forward. All are checked before the first is moved; a writer that comes between the two is told of by Conflict."""
        if not self._txn:
            return self._done(0)
        ready = []
        for t, old in self._txn["heads"].items():
            if t in self.tables and (mine := self.lake(t).head(self._txn["branch"]))["id"] != old:
                head = self.lake(t).head()
                if head["id"] != old:
                    self._close()
                    raise Conflict(f"somebody else has written {t} since BEGIN; nothing is committed")
                ready.append((t, head["number"] + 1, mine["id"]))
        for t, number, version in ready:
            self.lake(t)._move("main", number, version)
        self._close()
        return self._done(len(ready))

    _end = _commit

    def _release(self, s) -> DataFrame:
        want, points = name(solid(s)[-1]), self._txn["points"] if self._txn else []
        if not any(n == want for n, _ in points):
            raise LookupError(f"no savepoint {want}")
        while points.pop()[0] != want:
            pass
        return self._done(0)

    def _rollback(self, s) -> DataFrame:
        words = solid(s)
        want = name(words[-1]) if len(words) > 1 and any(w.is_("TO") for w in words) else None
        if not self._txn or (want and not any(n == want for n, _ in self._txn["points"])):
            raise LookupError("no such transaction or savepoint")
        if want is None:
            self._close()
            return self._done(0)
        points = self._txn["points"]
        while points[-1][0] != want:
            points.pop()
        for t, lsn in points[-1][1].items():
            if t in self.tables and self.lake(t).head(self._txn["branch"])["lsn"] != lsn:
                self.lake(t).rollback(lsn, self._txn["branch"])
        return self._done(0)

    # The rest

    def _attach(self, s) -> DataFrame:
        w = [x for x in solid(s) if not x.is_("DATABASE")]
        if len(self.attached) >= 10:
            raise ValueError("ten databases are attached already")
        self.attached[name(w[-1])] = Database(self.spark, w[1].text[1:-1])
        return self._done(0)

    def attach(self, alias: str, db: "Database") -> None:
        self.attached[alias] = db

    def _detach(self, s) -> DataFrame:
        del self.attached[name(solid(s)[-1])]
        return self._done(0)

    def _call(self, s) -> DataFrame:
        w = solid(s)
        b = next(i for i, x in enumerate(s) if x.text == "(")
        args = [x for x in split(s[b + 1 : closing(s, b)]) if solid(x)]
        values = self.spark.sql("SELECT " + ", ".join(translate(text(a))[0] for a in args)).first() if args else ()
        return self.procedures[name(w[1])](self, *values)

    def _explain(self, s) -> DataFrame:
        """EXPLAIN [QUERY PLAN] [ANALYZE] [FORMAT TEXT | TREE | JSON | YAML] query. ANALYZE runs the query and tells rows and times of each operator."""
        k, fmt, analyze = after(s, 0), "text", False
        while s[k].is_("QUERY", "PLAN", "ANALYZE", "FORMATTED", "FORMAT", "="):
            if s[k].is_("FORMAT"):
                k = after(s, k)
                k = after(s, k) if s[k].text == "=" else k
                fmt = s[k].text.lower()
            analyze |= s[k].is_("ANALYZE")
            k = after(s, k)
        run = self._query(s[k:])._jdf.queryExecution()
        if analyze:
            run.toRdd().count()
        if fmt == "text" and not analyze:
            lines = run.explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n")
        else:
            tree = _plan(run.executedPlan(), analyze)
            lines = json.dumps(tree, indent=2).split("\n") if fmt == "json" else list(_yaml(tree)) if fmt == "yaml" else list(_drawn(tree))
        return self.spark.createDataFrame(list(enumerate(lines)), "id int, detail string")

    def _pragma(self, s) -> DataFrame:
        w = solid(s)
        what = w[1].text.lower()
        if what == "foreign_keys":
            if len(w) > 2:
                self.foreign_keys = w[-1].text.strip(")").upper() in ("ON", "1", "TRUE", "YES")
            return self.spark.createDataFrame([(int(self.foreign_keys),)], "foreign_keys int")
        t = self.tables[name(w[3])] if len(w) > 3 else None
        mk = self.spark.createDataFrame
        if what == "table_info":
            return mk([(i, c, k, int(c in t.not_null), t.defaults.get(c), t.key.index(c) + 1 if c in t.key else 0) for i, (c, k) in enumerate(t.columns)], "cid int, name string, type string, notnull int, dflt_value string, pk int")
        if what == "index_list":
            return mk([(i, n, int(c in t.unique)) for i, (n, c) in enumerate(t.indexes.items())], "seq int, name string, unique int")
        if what == "foreign_key_list":
            return mk([(i, o, f, r) for i, (cols, o, theirs, *_) in enumerate(t.foreign) for f, r in zip(cols, theirs)], "id int, table string, `from` string, `to` string")
        if what == "foreign_key_check":
            out = None
            for x in [t] if t else self.tables.values():
                for i, (cols, other, theirs, *_) in enumerate(x.foreign):
                    bad = orphans(self.table(x.name), self.table(other), cols, theirs).select(F.lit(x.name).alias("table"), F.lit(other).alias("parent"), F.lit(i).alias("fkid"), F.to_json(F.struct(*cols)).alias("row"))
                    out = bad if out is None else out.unionByName(bad)
            return out if out is not None else mk([], "table string, parent string, fkid int, row string")
        if what == "table_list":
            return mk([("main", n, "table", len(x.columns)) for n, x in self.tables.items()] + [("main", n, "view", -1) for n in self.views], "schema string, name string, type string, ncol int")
        if what == "database_list":
            return mk([(0, "main", self.path)] + [(i + 2, n, d.path) for i, (n, d) in enumerate(self.attached.items())], "seq int, name string, file string")
        raise ValueError(f"no pragma {what}")


def orphans(rows: DataFrame, parent: DataFrame, cols: list[str], theirs: list[str]) -> DataFrame:
    """Rows whose foreign key, if no part is null, has no parent."""
    p = parent.select(*[F.col(c).alias(f"__p_{i}") for i, c in enumerate(theirs)])
    return rows.where(" and ".join(f"`{c}` is not null" for c in cols)).join(p, [F.col(c) == F.col(f"__p_{i}") for i, c in enumerate(cols)], "left_anti")


def _prefixed(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`").alias(prefix + c) for c in rows.columns])


def _unprefixed(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`").alias(c.removeprefix(prefix)) for c in rows.columns if c.startswith(prefix)])


def _told(tokens: list[Token]) -> list[Token]:
    """NEW.x and OLD.x as columns of mr_changed."""
    out, i = [], 0
    while i < len(tokens):
        t = tokens[i]
        d = after(tokens, i)
        if t.is_("NEW", "OLD") and d < len(tokens) and tokens[d].text == ".":
            c = after(tokens, d)
            out.append(Token("raw", f"mr_changed.{t.text.lower()}_{name(tokens[c])}"))
            i = c + 1
            continue
        out.append(t)
        i += 1
    return out


def _action(p: list[Token], event: str) -> str:
    """What a foreign key does ON DELETE or ON UPDATE."""
    w = [t.text.upper() for t in solid(p)]
    for i in range(len(w) - 2):
        if w[i] == "ON" and w[i + 1] == event:
            return w[i + 2] if w[i + 2] in ("CASCADE", "RESTRICT") else " ".join(w[i + 2 : i + 4])
    return "NO ACTION"


def _plan(node, analyze: bool) -> dict:
    """A physical plan as nested dicts; stages of an adaptive plan are looked through."""
    kind = node.nodeName()
    if kind == "AdaptiveSparkPlan":
        return _plan(node.executedPlan(), analyze)
    if kind.endswith("QueryStage"):
        return _plan(node.plan(), analyze)
    children = node.children()
    out: dict = {"operator": kind.split(" (")[0].strip(), "detail": node.simpleString(25)}
    if analyze:
        metrics = node.metrics()
        out |= {k: metrics.apply(k).value() for k in ("numOutputRows", "scanTime", "sortTime", "aggTime", "pipelineTime") if metrics.contains(k)}
    return out | {"children": [_plan(children.apply(i), analyze) for i in range(children.length())]}


def _drawn(tree: dict, depth: int = 0):
    told = ", ".join(f"{k}={v}" for k, v in tree.items() if k not in ("operator", "detail", "children"))
    yield f"{'  ' * depth}{'+- ' if depth else ''}{tree['detail']}{f' [{told}]' if told else ''}"
    for c in tree["children"]:
        yield from _drawn(c, depth + 1)


def _yaml(tree: dict, depth: int = 0):
    pad = "  " * depth
    for i, (k, v) in enumerate((k, v) for k, v in tree.items() if k != "children"):
        yield f"{pad}{'- ' if i == 0 else '  '}{k}: {json.dumps(v)}"
    if tree["children"]:
        yield f"{pad}  children:"
        for c in tree["children"]:
            yield from _yaml(c, depth + 2)


def _back(s: list[Token], i: int, word: str) -> int:
    while i >= 0 and not s[i].is_(word):
        i -= 1
    return i


def _assignments(tokens: list[Token]) -> dict[str, str]:
    """column = expression, ... by column."""
    out = {}
    for part in split(tokens):
        eq = next(i for i, t in enumerate(part) if t.text == "=")
        out[name(solid(part[:eq])[-1])] = text(part[eq + 1 :]).strip()
    return out


def _qualified(expr: str, columns: list[str]) -> str:
    """Bare columns of an upsert's expression as the table's own."""
    toks = lex(expr)
    out = []
    for i, t in enumerate(toks):
        bare = t.kind in ("word", "quoted") and name(t) in columns and (i == 0 or toks[i - 1].text != ".")
        out.append(Token("raw", f"mr_t.`{name(t)}`") if bare else t)
    return text(out)


def _translate_tokens(tokens: list[Token]) -> tuple[str, list[str]]:
    """SQLite's functions and words in Spark's."""
    sql, names = translate(text(tokens))
    return text(rewrite_calls(_spark_tokens(sql))), names


def _spark_tokens(sql: str) -> list[Token]:
    """Tokens of Spark SQL, whose literals escape quotes with a backslash."""
    out, at = [], 0
    for m in re.finditer(r"'(?:[^'\\]|\\.)*'", sql, re.S):
        out += [*lex(sql[at : m.start()]), Token("string", m[0])]
        at = m.end()
    return [*out, *lex(sql[at:])]
