"""Holds queries against their SQL, run by DuckDB on the same files: python tests/oracle.py [FOLDER] NAME..."""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    """A value as both engines give it."""
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (np.ndarray, list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, dict):
        return tuple(sorted((plain(k), plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    return v


def key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)) if not isinstance(v, (int, float)) else "", v if not isinstance(v, tuple) else str(v)) if v is not None else (True, "", 0) for v in row)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: str(key(r)))


def connection(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def compare(spark, con, query, sql: str, folder: str) -> str | None:
    """What differs, or None."""
    df = query(spark, folder)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(names, cur.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows and {len(theirs)}; first ours {ours[:2]}, theirs {theirs[:2]}"
    for a, b in zip(ours, theirs, strict=True):
        if a != b:
            n = sum(x != y for x, y in zip(ours, theirs, strict=True))
            return f"{n} of {len(ours)} rows differ; columns {sorted(names)}: {a} and {b}"
    kinds = [{int: "n", float: "f"}.get(type(x), "o") for x in (ours[0] if ours else ())]
    other = [{int: "n", float: "f"}.get(type(x), "o") for x in (theirs[0] if theirs else ())]
    return None if kinds == other else f"types {kinds} and {other}: {ours[0]} and {theirs[0]}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from conftest import session

    from geoloom.plans import registry as entry

    if any(x.startswith(("op", "pipeline")) for x in sys.argv[1:]):
        import __spark_entry__ as entry

    folder, names = ("/root/testdata/sf0.001", sys.argv[1:]) if not sys.argv[1:] or "/" not in sys.argv[1] else (sys.argv[1], sys.argv[2:])
    spark, con, all_, sqls = session(int(os.environ.get("CORES", "2"))), connection(folder), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in [n for n in all_ if not names or any(n.startswith(x) for x in names)]:
        began = time.time()
        try:
            if name in sqls:
                why = compare(spark, con, all_[name], sqls[name], folder)
            else:
                why = None if (n := len(all_[name](spark, folder).collect())) else "no rows"
                name += f" (no SQL, {n} rows)"
        except Exception as e:
            why = f"{type(e).__name__}: {str(e)[:700]}"
        bad += why is not None
        print(f"{'ok ' if why is None else 'BAD'} {time.time() - began:5.1f} {name}" + (f"\n      {why[:900]}" if why else ""), flush=True)
    print("bad:", bad)
