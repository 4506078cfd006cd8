"""Compare registered queries with their SQL: ``python tests/check_oracle.py [sf_dir] [name ..]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from rollbook.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def normal(value: object) -> object:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def rows(table, columns: list[str]) -> list[tuple]:
    data = table.select(columns).to_pylist()
    return sorted(tuple(normal(r[c]) for c in columns) for r in data)


def compare(spark, con, name: str, sf_dir: str) -> str:
    """Empty when the query and its SQL agree, else what differs."""
    got = queries()[name](spark, sf_dir).toArrow()
    want = con.sql(oracle_sql()[name]).to_arrow_table()
    columns = sorted(got.column_names)
    if columns != sorted(want.column_names):
        return f"columns {columns} != {sorted(want.column_names)}"
    kinds = {c: (got.schema.field(c).type, want.schema.field(c).type) for c in columns}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and "string" not in str(k[0])}
    a, b = rows(got, columns), rows(want, columns)
    if a != b:
        only_a = sorted(set(a) - set(b))[:3]
        only_b = sorted(set(b) - set(a))[:3]
        return f"{len(a)} rows != {len(b)} rows\n  columns {columns}\n  got  {only_a}\n  want {only_b}"
    if odd:
        print(f"   note: types differ {odd}")
    return "" if a else "both empty"


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    db = duck(folder)
    for query in sys.argv[2:] or list(queries()):
        if query not in oracle_sql():
            print("no SQL ", query)
            continue
        began = time.time()
        try:
            problem = compare(session, db, query, folder)
        except Exception as error:  # show every query's failure in one run
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print("FAIL" if problem else "ok  ", query, f"{time.time() - began:.1f}s", problem, flush=True)
