"""Compare queries with their SQL on one data folder.

    python tests/oracle_check.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, decimal.Decimal):
        value = float(value) if value % 1 else int(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool):
        return str(value)
    return "null" if value is None else str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str | None) -> str:
    """Empty when equal, else what differs."""
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return "" if got else "no rows"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} want {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows, want {len(want)}; first {str(got[:2])[:300]} want {str(want[:2])[:300]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if not bad:
        return ""
    cells = [(g[:120], w[:120]) for g, w in zip(*bad[0]) if g != w]
    return f"{len(bad)} rows differ, e.g. {str(cells)[:600]}"


def main(sf_dir: str, names: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as contract
    from irquarry.session import build_session

    spark = build_session("check", "local[8]", 8, "8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    plans, sqls = contract.queries(), contract.oracle_sql()
    failed = 0
    for name in names or plans:
        start = time.time()
        try:
            problem = compare(plans[name](spark, sf_dir), con, sqls.get(name))
        except Exception:
            problem = traceback.format_exc()[-1800:]
        kind = "sql" if name in sqls else "rows"
        print(f"{'ok  ' if not problem else 'FAIL'} {name} [{kind}] {time.time() - start:.1f}s {problem}", flush=True)
        failed += bool(problem)
    print(f"{len(names or plans)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
