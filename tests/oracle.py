"""Compare registered queries with their SQL text in DuckDB."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf: str):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _cell(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(_cell(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf, name, fn, sql):
    """Return (ok, note)."""
    start = time.time()
    df = fn(spark, sf)
    got_names, got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return True, f"rows only {len(got)} {took:.1f}s"
    start = time.time()
    rel = con.sql(sql)
    want_names, want = rows_of(rel.columns, rel.fetchall())
    duck = time.time() - start
    note = f"rows {len(got)} spark {took:.1f}s duck {duck:.1f}s"
    if got_names != want_names:
        return False, f"columns {got_names} vs {want_names}"
    if len(got) != len(want):
        return False, f"{note}: {len(want)} rows expected; first got {got[:2]} want {want[:2]}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        return False, f"{note}: {len(bad)} rows differ, e.g. {bad[:2]}"
    types = {c: t for c, t in df.dtypes}
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    odd = [(c, types[c], duck_types[c]) for c in types if duck_types[c] in ("HUGEINT",) or duck_types[c].startswith("DECIMAL")]
    if odd:
        return False, f"{note}: types {odd}"
    if not got:
        note += " EMPTY"
    return True, note


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import re

    import __spark_entry__ as entry
    from lumentab.session import local_session

    sf = "/root/testdata/sf" + (sys.argv[2] if len(sys.argv) > 2 else "0.01")
    pattern = re.compile(sys.argv[1] if len(sys.argv) > 1 else ".")
    spark, con = local_session(8), connection(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = []
    for name, fn in queries.items():
        if not pattern.search(name):
            continue
        try:
            ok, note = compare(spark, con, sf, name, fn, oracle.get(name))
        except Exception as exc:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed:", failed)
