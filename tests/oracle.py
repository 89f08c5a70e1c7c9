"""Run a registered query and its SQL twin and compare rows exactly.

As a script: ``python tests/oracle.py <sf_dir> [name-prefix …]``.
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from evalframe.plans import load_all  # noqa: E402
from evalframe.plans.registry import ORACLE, QUERIES  # noqa: E402

load_all()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(sf).glob("*.parquet")):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def difference(name: str, spark, connection, sf: str, query=None, sql: str | None = None) -> str | None:
    """None when equal, else what differs first. ``query`` and ``sql`` replace the registered ones."""
    df = (query or QUERIES[name])(spark, sf)
    got = _rows(df.columns, [tuple(x) for x in df.collect()])
    sql = sql or ORACLE.get(name)
    if sql is None:
        return None if got else "no rows"
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    want = _rows(names, result.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}: {got[:2]} … {want[:2]}"
    if not got:
        return "no rows on either side"
    kinds = {t[1] for t in df.dtypes}
    for a, b in zip(got, want):
        if a != b or any(type(x) is not type(y) for x, y in zip(a, b)):
            return f"{sorted(df.columns)}: {a} != {b} ({kinds})"
    return None


def main(sf: str, prefixes: list[str]) -> int:
    from evalframe.runtime import session

    spark = session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("OFF")
    connection = duck(sf)
    failed = 0
    for name in QUERIES:
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            problem = difference(name, spark, connection, sf)
        except Exception:
            problem = traceback.format_exc()[-1500:]
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
