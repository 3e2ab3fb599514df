"""Compare registered queries with their SQL: same columns, same row multiset. Usable as a script."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rasterloom.plans.fixtures import TABLES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return db


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "null" if v is None else repr(float(v) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(text(row[i]) for i in order) for row in rows)


def compare(df, db, sql: str) -> str:
    """Empty when equal, else what differs."""
    found = [tuple(r) for r in df.collect()]
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    wanted = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    a, b = _rows(df.columns, found), _rows(names, wanted)
    if a == b:
        return "" if a else "no rows"
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"{len(a)} / {len(b)} rows over {sorted(names)}; only here {only_a}; only in SQL {only_b}"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from rasterloom.session import local_session

    sf, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(f"/root/testdata/{sf}")
    sql = oracle_sql()
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, f"/root/testdata/{sf}")
            problem = compare(df, db, sql[name]) if name in sql else f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok  ' if not problem else 'DIFF'} {name} {time.time() - start:.1f}s {problem}", flush=True)
