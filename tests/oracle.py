"""Compare registered queries with their SQL on DuckDB (in process)."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value: object) -> object:
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def kinds(rows: list[tuple]) -> list[str]:
    out = []
    for i in range(len(rows[0]) if rows else 0):
        names = {type(cell(r[i])).__name__ for r in rows} - {"NoneType"}
        out.append("/".join(sorted(names)))
    return out


def mismatch(spark, con, sf_dir: str, fn, sql: str) -> str:
    """Empty text when both sides agree."""
    frame = fn(spark, sf_dir)
    ours = [tuple(r) for r in frame.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    a, b = canonical(frame.columns, ours), canonical(names, theirs)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][0]
        return f"values differ, e.g. spark {diff[0]} sql {diff[1]}"
    if kinds(a) != kinds(b):
        return f"types differ: {kinds(a)} != {kinds(b)}"
    return "" if a else "EMPTY"


if __name__ == "__main__":
    from logloom.session import local_session

    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry

    sf = f"/root/testdata/sf{sys.argv[1]}"
    spark, con = local_session(8), connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:]
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                note = mismatch(spark, con, sf, fn, oracles[name]) or "ok"
            else:
                note = f"rows only: {fn(spark, sf).count()}"
        except Exception as problem:
            note = "ERROR " + str(problem)[:600]
        print(f"{name:32s} {time.time() - start:6.2f}s {note}", flush=True)
