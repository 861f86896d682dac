"""python tests/compare.py [--strict] [--sf DIR] [NAME...]: queries beside their SQL in DuckDB, as the driver does; prints what differs."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


STRICT = False  # whether floats must agree to the last digit and numbers in kind


def norm(v):
    import decimal

    if STRICT and isinstance(v, (int, float, decimal.Decimal)):
        return (type(v).__name__, repr(v))

    import numpy as np

    if isinstance(v, np.ndarray):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else ("n", f"{v:.6g}")
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("n", f"{v:.6g}") if abs(v) < 10**6 else ("n", str(v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def duck(sf_dir: str):
    import duckdb

    from millrace.session import TABLES

    c = duckdb.connect()
    for t in TABLES:
        p = Path(f"{sf_dir}/{t}.parquet")
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        c.execute(f"create view {t} as select * from read_parquet('{at}')")
    return c


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr), [cols[i] for i in order]


def compare(spark, con, name, f, sql, sf_dir):
    """'' if both give the same rows, else what differs."""
    df = f(spark, sf_dir)
    mine, mine_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"(no SQL; {len(mine)} rows)" if mine else "(no SQL) NO ROWS"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    theirs, their_cols = rows_of(cols, cur.fetchall())
    if mine_cols != their_cols:
        return f"columns {mine_cols} against {their_cols}"
    if mine != theirs:
        a, b = set(map(repr, mine)), set(map(repr, theirs))
        return f"rows {len(mine)} against {len(theirs)}; only mine {sorted(a - b)[:3]}; only theirs {sorted(b - a)[:3]}"
    return ""


def main() -> None:
    import __spark_entry__ as e
    from millrace.session import local_session

    global STRICT
    args = [a for a in sys.argv[1:] if a != "--strict"]
    STRICT = "--strict" in sys.argv
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark, con = local_session(), duck(sf)
    qs, sql = e.queries(), e.oracle_sql()
    bad = 0
    for n in [k for k in qs if not args or any(k == a or (a.endswith("*") and k.startswith(a[:-1])) for a in args)]:
        t = time.time()
        try:
            why = compare(spark, con, n, qs[n], sql.get(n), sf)
        except Exception as x:
            why = f"{type(x).__name__}: {str(x)[:700]}"
        ok = not why or why.startswith("(no SQL;")
        bad += not ok
        print(f"{'ok  ' if ok else 'BAD '} {n} {time.time() - t:.1f}s {why}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
