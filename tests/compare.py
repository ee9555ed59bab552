"""Run named queries in Spark and their SQL in DuckDB and compare whole results.

    python tests/compare.py sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = Path("/root/testdata")


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in (DATA / sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0) if v != 0 else "0.0"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT"}


def compare(spark, con, sf: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    t = time.time()
    df = fn(spark, str(DATA / sf))
    cols, got = df.columns, df.collect()
    took = time.time() - t
    if sql is None:
        return False, f"no SQL to compare {len(got)} rows with, {took:.1f}s"
    t = time.time()
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    otypes = {d[0]: str(d[1]) for d in res.description}
    want = res.fetchall()
    odt = time.time() - t
    if sorted(cols) != sorted(ocols):
        return False, f"columns {sorted(cols)} vs {sorted(ocols)}"
    bad = [(f.name, f.dataType.simpleString(), otypes[f.name]) for f in df.schema if TYPE.get(f.dataType.simpleString()) != otypes[f.name]]
    note = f" TYPES {bad}" if bad else ""
    a, b = rows_of(cols, got), rows_of(ocols, want)
    if a != b:
        sa, sb = set(a), set(b)
        return False, f"{len(a)} vs {len(b)} rows; only spark {sorted(sa - sb)[:3]} only duck {sorted(sb - sa)[:3]}; cols {sorted(cols)}{note}"
    return not bad, f"{len(a)} rows, spark {took:.1f}s duck {odt:.1f}s{note}"


def main() -> None:
    import __spark_entry__ as e
    from manyview.session import get_session

    sf = sys.argv[1]
    names = sys.argv[2:]
    qs, sqls = e.queries(), e.oracle_sql()
    spark, con = get_session("local[8]"), duck(sf)
    fails = []
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            ok, msg = compare(spark, con, sf, name, fn, sqls.get(name))
        except Exception as ex:  # noqa: BLE001
            ok, msg = False, f"{type(ex).__name__}: {str(ex)[:600]}"
        print("ok  " if ok else "FAIL", name, msg, flush=True)
        if not ok:
            fails.append(name)
    print("failed:", fails)


if __name__ == "__main__":
    main()
