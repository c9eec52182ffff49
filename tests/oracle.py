"""Compare registered queries with their SQL, run by an independent engine.

    python -m tests.oracle [folder] [query ...]
"""

from __future__ import annotations

import datetime as dt
import sys
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')"
        )
    return connection


def _cell(value):
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_cell(row[i]) for i in order) for row in rows),
        key=lambda r: tuple((v is None, str(v)) for v in r),
    )


def difference(spark, connection, name: str, folder: str) -> str | None:
    """``None`` when the two results are equal, else what differs."""
    from __spark_entry__ import oracle_sql, queries

    frame = queries()[name](spark, folder)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in plan or "NestedLoopJoin" in plan:
        return "the plan holds a cross join"
    mine = _rows(frame.columns, frame.collect())
    if name not in oracle_sql():
        return None if mine else "no rows"
    result = connection.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    theirs = _rows(columns, result.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} instead of {sorted(columns)}"
    if mine != theirs:
        extra = [r for r in mine if r not in set(theirs)][:3] if len(mine) < 100_000 else []
        lost = [r for r in theirs if r not in set(mine)][:3] if len(mine) < 100_000 else []
        return f"{len(mine)} rows instead of {len(theirs)}; extra {extra}; missing {lost}"[:1500]
    return None


def main(arguments: list[str]) -> int:
    from __spark_entry__ import queries
    from tidegauge.session import local_session

    folder = arguments[0] if arguments else "/root/testdata/sf0.01"
    names = arguments[1:] or list(queries())
    spark, connection, failed = local_session(8), connect(folder), 0
    for name in names:
        started = time.time()
        try:
            problem = difference(spark, connection, name, folder)
        except Exception:
            problem = traceback.format_exc()[-1500:]
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - started:.1f}s", flush=True)
        if problem:
            print("     ", problem, flush=True)
    print(f"{len(names) - failed} of {len(names)} equal")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
