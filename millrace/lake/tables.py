"""Tables as immutable Parquet directories and numbered manifests: snapshots, time travel, rollback, branches, merges, row-level changes.

A commit writes data first, then one manifest that names all its directories, then moves the branch to it by a rename that fails if somebody
else took the number: readers see the old or the new version, never half of one, and a writer that loses is told so (Conflict). Changes of rows
are data directories and directories of delete keys, as in upserts.py: a key takes away rows of the directories before it. Small files (manifests,
pointers) are read without Spark jobs.
"""

from __future__ import annotations

import datetime
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..operators.relational import three_way_merge, version_diff
from . import files
from .compaction import checksum, clustered, directory_files

RETAIN = 100
GRACE = 3600  # seconds that a directory no version names is kept for, as a writer may be about to commit it


class Conflict(RuntimeError):
    """Somebody else committed first."""


class LakeTable:
    """A table under a path. Versions are manifests; a branch is a sequence of pointers to versions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _put(self, name: str, content: dict) -> bool:
        """Write a small file that wasn't there; False if it is."""
        return files.put(self.spark, f"{self.path}/{name}", content)

    def _get(self, name: str) -> dict:
        return files.get(self.spark, f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        return files.names(self.spark, f"{self.path}/{folder}")

    # Versions

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType | str, partition_by: list[str] | None = None, **properties) -> "LakeTable":
        """A new, empty table; ValueError if there is one."""
        t = cls(spark, path)
        if t._names("branches"):
            raise ValueError(f"there is a table at {path}")
        s = spark.createDataFrame([], schema).schema
        v = t._manifest({"parent": None, "operation": "create", "dirs": [], "schema": s.json(), "schema_id": 0, "partition_by": partition_by or [], "properties": properties, "lsn": 0})
        t._move("main", 0, v)
        return t

    def _manifest(self, m: dict) -> str:
        m = m | {"id": uuid.uuid4().hex, "at": m.get("at") or datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="microseconds")}
        self._put(f"manifests/{m['id']}.json", m)
        return m["id"]

    def manifest(self, version: str) -> dict:
        return self._get(f"manifests/{version}.json")

    def _move(self, branch: str, number: int, version: str) -> None:
        if not self._put(f"branches/{branch}/{number:010d}.json", {"version": version}):
            raise Conflict(f"{branch} has moved past {number - 1}")

    def _pointers(self, branch: str) -> list[str]:
        names = self._names(f"branches/{branch}")
        if not names:
            raise ValueError(f"no branch {branch}")
        return names

    def head(self, branch: str = "main") -> dict:
        """The manifest a branch points at, and the number of its pointer."""
        last = self._pointers(branch)[-1]
        return self.manifest(self._get(f"branches/{branch}/{last}")["version"]) | {"number": int(last[:-5])}

    def log(self, branch: str = "main") -> list[dict]:
        """Versions from the newest back to the first."""
        out, v = [], self.head(branch)
        while True:
            out.append(v)
            if not v["parent"]:
                return out
            v = self.manifest(v["parent"])

    def snapshots(self, branch: str = "main") -> DataFrame:
        """sequence_number, snapshot_id, parent_id, committed_at, operation, directories, schema_id of each version."""
        rows = [(v["lsn"], v["id"], v["parent"], v["at"], v["operation"], len(v["dirs"]), v["schema_id"]) for v in reversed(self.log(branch))]
        return self.spark.createDataFrame(rows, "sequence_number bigint, snapshot_id string, parent_id string, committed_at string, operation string, directories int, schema_id int").withColumn("committed_at", F.to_timestamp("committed_at"))

    def resolve(self, branch: str = "main", version: int | str | None = None, timestamp: str | None = None) -> dict:
        """The version with a number or id, or the last one at or before a time, or the head; LookupError if there is none."""
        if version is None and timestamp is None:
            return self.head(branch)
        log = self.log(branch)
        if version is not None:
            hit = [v for v in log if str(v["lsn"]) == str(version) or v["id"] == str(version)]
        else:
            t = datetime.datetime.fromisoformat(str(timestamp))
            t = t if t.tzinfo else t.replace(tzinfo=datetime.timezone.utc)
            hit = [v for v in log if datetime.datetime.fromisoformat(v["at"]) <= t]
        if not hit:
            raise LookupError(f"no version {version if version is not None else timestamp} of {self.path} on {branch}")
        return hit[0]

    def _stored(self, entries: list[dict], fields: list[StructField], names: dict, defaults: dict) -> DataFrame:
        """Rows of directories that have the same column names, by one reader; their columns as fields."""
        stored = entries[0]["names"]  # name in the files by the column's id
        at = {f.name: stored.get(str(names.get(f.name, f.name))) for f in fields}
        rows = self.spark.read.schema(StructType([StructField(at[f.name], f.dataType) for f in fields if at[f.name]])).parquet(*[f"{self.path}/data/{d['dir']}" for d in entries])
        return rows.select(*[F.col(f"`{at[f.name]}`").alias(f.name) if at[f.name] else F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in fields])

    def _read(self, v: dict) -> DataFrame:
        """Rows of a version: one reader for all directories between two deletes, and one anti-join with the delete keys."""
        schema, names, defaults = StructType.fromJson(json.loads(v["schema"])), v.get("names", {}), v.get("defaults", {})
        if not v["dirs"]:
            return self.spark.createDataFrame([], schema)
        deletes = v.get("deletes", [])
        groups: dict[tuple, list[dict]] = {}
        for d in v["dirs"]:
            epoch = sum(x["no"] <= d.get("no", 0) for x in deletes)
            groups.setdefault((json.dumps(d["names"], sort_keys=True), epoch), []).append(d)
        out = None
        for (_, epoch), entries in groups.items():
            part = self._stored(entries, schema.fields, names, defaults).withColumn("__epoch", F.lit(epoch))
            out = part if out is None else out.unionByName(part)
        for key in sorted({tuple(x["key"]) for x in deletes}):
            gone = None
            for k, x in enumerate(deletes):
                if tuple(x["key"]) == key:
                    own = [f for f in schema.fields if str(names.get(f.name, f.name)) in key]
                    part = self._stored([x], own, names, {}).select(*[F.col(f"`{f.name}`").alias(f"__d{i}") for i, f in enumerate(own)], F.lit(k).alias("__no"))
                    gone = part if gone is None else gone.unionByName(part)
            gone = gone.groupBy(*[f"__d{i}" for i in range(len(own))]).agg(F.max("__no").alias("__no"))
            on = F.col("__epoch") <= F.col("__no")
            for i, f in enumerate(own):
                on = (F.col(f"`{f.name}`") == F.col(f"__d{i}")) & on
            out = out.join(gone, on, "left_anti")
        return out.drop("__epoch")

    def read(self, branch: str = "main", version: int | str | None = None, timestamp: str | None = None) -> DataFrame:
        return self._read(self.resolve(branch, version, timestamp))

    def _store(self, df: DataFrame, head: dict) -> dict:
        name = uuid.uuid4().hex
        w = df.write.mode("error")
        by = [c for c in head["partition_by"] if c in df.columns]
        if by and len(by) < len(df.columns):
            w = w.partitionBy(*by)
        w.parquet(f"{self.path}/data/{name}")
        ids = head.get("names", {})
        return {"dir": name, "names": {str(ids.get(c, c)): c for c in df.columns}, "no": head["lsn"] + 1}

    def commit(self, operation: str, dirs: list[dict], branch: str = "main", on: dict | None = None, **change) -> dict:
        """A new version on top of on (the head as it was read). Conflict if the branch has moved."""
        head = on or self.head(branch)
        keep = {k: head[k] for k in ("schema", "schema_id", "partition_by", "properties", "names", "defaults", "deletes") if k in head}
        v = self._manifest(keep | {"parent": head["id"], "operation": operation, "dirs": dirs, "lsn": head["lsn"] + 1} | change)
        self._move(branch, head["number"] + 1, v)
        return self.head(branch)

    def _shaped(self, df: DataFrame, head: dict) -> DataFrame:
        """df with the table's columns, by name; missing ones are null (or the default)."""
        schema = StructType.fromJson(json.loads(head["schema"]))
        return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(head.get("defaults", {}).get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields])

    def append(self, df: DataFrame, branch: str = "main", on: dict | None = None) -> dict:
        """Add rows. Columns are matched by name; missing ones are null (or the default)."""
        head = on or self.head(branch)
        return self.commit("append", [*head["dirs"], self._store(self._shaped(df, head), head)], branch, head)

    def change(self, gone: DataFrame | None, rows: DataFrame | None, key: list[str], branch: str = "main", on: dict | None = None, operation: str = "change") -> dict:
        """Take away the rows whose key is in gone and add rows, in one version that rewrites nothing. Keys with a null part take nothing away."""
        head = on or self.head(branch)
        dirs, deletes = list(head["dirs"]), list(head.get("deletes", []))
        if gone is not None:
            names = head.get("names", {})
            deletes.append(self._store(gone.select(*key).distinct(), head) | {"key": [str(names.get(c, c)) for c in key]})
        if rows is not None:
            dirs.append(self._store(self._shaped(rows, head), head))
        return self.commit(operation, dirs, branch, head, deletes=deletes)

    def overwrite(self, df: DataFrame, branch: str = "main", operation: str = "overwrite", on: dict | None = None) -> dict:
        """Replace all rows."""
        head = on or self.head(branch)
        return self.commit(operation, [self._store(self._shaped(df, head), head)], branch, head, deletes=[])

    def compact(self, keys: list[str], target: int = 128 * 1024 * 1024, branch: str = "main") -> dict:
        """The same rows in few sorted files, in a version of their own; ValueError if counts or checksums differ."""
        head = self.head(branch)
        rows = self._read(head)
        size = sum(directory_files(self.spark, f"{self.path}/data/{d['dir']}")[1] for d in head["dirs"])
        new = self._store(clustered(rows, keys, -(-size // target)), head)
        if checksum(rows) != checksum(self._read(head | {"dirs": [new], "deletes": []})):
            raise ValueError("the compacted rows don't reconcile")
        return self.commit("replace", [new], branch, head, deletes=[])

    def rollback(self, version: int | str, branch: str = "main") -> dict:
        """A new version that is as an old one was."""
        head, old = self.head(branch), self.resolve(branch, version)
        return self.commit("rollback", old["dirs"], branch, head, deletes=old.get("deletes", []), **{k: old[k] for k in ("schema", "schema_id", "names", "defaults") if k in old})

    def alter(self, add: dict[str, str] | None = None, drop: list[str] | None = None, rename: dict[str, str] | None = None, defaults: dict | None = None, branch: str = "main") -> dict:
        """Change the columns without touching data. Renamed columns keep their values; a dropped name that is added again starts empty."""
        head = self.head(branch)
        fields = {f["name"]: f for f in json.loads(head["schema"])["fields"]}
        names = {c: head.get("names", {}).get(c, c) for c in fields}
        for old, new in (rename or {}).items():
            fields = {new if c == old else c: f | ({"name": new} if c == old else {}) for c, f in fields.items()}
            names[new] = names.pop(old)
        for c in drop or []:
            del fields[c]
            names.pop(c)
        for c, kind in (add or {}).items():
            fields[c] = json.loads(self.spark.createDataFrame([], f"`{c}` {kind}").schema.json())["fields"][0]
            names[c] = f"{c}#{head['schema_id'] + 1}"
        return self.commit("alter", head["dirs"], branch, head, schema=json.dumps({"type": "struct", "fields": list(fields.values())}), schema_id=head["schema_id"] + 1, names=names, defaults=head.get("defaults", {}) | (defaults or {}))

    def diff(self, old: int | str, new: int | str, key: list[str], branch: str = "main") -> DataFrame:
        """Rows that differ between two versions, with _change_type."""
        return version_diff(self.read(branch, old), self.read(branch, new), key)

    def between(self, start: str, end: str, branch: str = "main") -> DataFrame:
        """Rows of every version that was current at some time from start to end, with _version."""
        utc = lambda x: (t := datetime.datetime.fromisoformat(x)) if (t := datetime.datetime.fromisoformat(x)).tzinfo else t.replace(tzinfo=datetime.timezone.utc)
        lo, hi, out, until = utc(start), utc(end), None, None
        for v in self.log(branch):
            at = datetime.datetime.fromisoformat(v["at"])
            if at <= hi and (until is None or until > lo):
                part = self._read(v).withColumn("_version", F.lit(v["lsn"]).cast("bigint"))
                out = part if out is None else out.unionByName(part, allowMissingColumns=True)
            until = at
        return out if out is not None else self._read(self.head(branch)).limit(0).withColumn("_version", F.lit(0).cast("bigint"))

    def prune(self, retain: int = RETAIN, branch: str = "main", grace: float = GRACE) -> int:
        """Delete the data directories that neither the last retain versions nor any branch needs; how many. Those younger than grace seconds stay."""
        kept = [v for b in self.branches() for v in (self.log(b)[:retain] if b == branch else self.log(b))]
        keep = {d["dir"] for v in kept for d in [*v["dirs"], *v.get("deletes", [])]}
        old = time.time() - grace
        gone = [n for n in self._names("data") if n not in keep and files.modified(self.spark, f"{self.path}/data/{n}") <= old]
        for n in gone:
            files.remove(self.spark, f"{self.path}/data/{n}")
        return len(gone)

    # Branches

    def branches(self) -> list[str]:
        return self._names("branches")

    def branch(self, name: str, source: str = "main", version: int | str | None = None) -> None:
        """A new branch at a version of another."""
        if name in self.branches():
            raise ValueError(f"there is a branch {name}")
        self._move(name, 0, self.resolve(source, version)["id"])

    def drop_branch(self, name: str) -> None:
        if name == "main":
            raise ValueError("main can't be dropped")
        files.remove(self.spark, f"{self.path}/branches/{name}")

    def _ancestors(self, v: dict) -> list[str]:
        out, todo, seen = [], [v["id"]], set()
        while todo:
            i = todo.pop(0)
            if i and i not in seen:
                seen.add(i)
                out.append(i)
                m = self.manifest(i)
                todo += [m["parent"], m.get("merged")]
        return out

    def merge_base(self, a: str, b: str) -> dict:
        """The latest version that both branches have."""
        theirs = set(self._ancestors(self.head(b)))
        return self.manifest(next(i for i in self._ancestors(self.head(a)) if i in theirs))

    def compare(self, a: str, b: str) -> tuple[int, int]:
        """Versions that only a has, and that only b has."""
        x, y = set(self._ancestors(self.head(a))), set(self._ancestors(self.head(b)))
        return len(x - y), len(y - x)

    def history(self, branch: str = "main") -> DataFrame:
        """Every version a branch descends from, merged ones too: snapshot_id, parent_id, merged_id, sequence_number, operation, depth (steps back by the shortest way)."""
        rows, depth, todo = [], {}, [(self.head(branch)["id"], 0)]
        while todo:
            i, d = todo.pop(0)
            if i and i not in depth:
                depth[i], m = d, self.manifest(i)
                rows.append((i, m["parent"], m.get("merged"), m["lsn"], m["operation"], d))
                todo += [(m["parent"], d + 1), (m.get("merged"), d + 1)]
        return self.spark.createDataFrame(rows, "snapshot_id string, parent_id string, merged_id string, sequence_number bigint, operation string, depth int")

    def merge(self, source: str, key: list[str], into: str = "main", strategy: str = "abort", fast_forward: bool = True, squash: bool = False) -> dict:
        """Bring a branch's changes in, row by row against the common base.

        A fast forward just moves the branch. strategy says what becomes of rows both sides changed: 'abort' (Conflict), 'ours' or 'theirs'.
        squash makes one version that doesn't remember the branch.
        """
        ours, theirs, base = self.head(into), self.head(source), self.merge_base(into, source)
        if base["id"] == theirs["id"]:
            return ours
        if base["id"] == ours["id"] and fast_forward and not squash:
            self._move(into, ours["number"] + 1, theirs["id"])
            return self.head(into)
        m = three_way_merge(self._read(base), self._read(ours), self._read(theirs), key)
        if strategy == "abort":
            n = m.where("_side = 'conflict'").count()
            if n:
                raise Conflict(f"{n} rows changed on both sides")
        cols = self._read(ours).columns
        clash = F.col("_side") == "conflict"
        pick = F.col("_theirs") if strategy == "theirs" else F.struct(*cols)
        # A conflict whose chosen side deleted the row drops it; ours without a row has only nulls beside the key.
        gone = m.where(clash).select(*key).join(self._read(ours).select(*key), key, "left_anti").withColumn("__gone", F.lit(True)) if strategy != "theirs" else None
        rows = m.withColumn("__r", F.when(clash, pick).otherwise(F.struct(*cols)))
        rows = rows.where("__r is not null") if gone is None else rows.join(gone, key, "left").where("__gone is null")
        return self.commit("squash" if squash else "merge", [self._store(rows.select("__r.*"), ours)], into, ours, deletes=[], **({} if squash else {"merged": theirs["id"]}))
