"""Run registered queries against their SQL in DuckDB and compare rows, names, types and values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _kind(value):
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, (float, decimal.Decimal)):
        return "float"
    if isinstance(value, datetime.datetime):
        return "timestamp"
    return type(value).__name__


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    return value


def normal(names: list[str], rows) -> tuple[list[str], list[tuple], list[set]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    kinds = [{_kind(r[i]) for r in rows if r[i] is not None} for i in order]
    return [names[i] for i in order], sorted(out, key=repr), kinds


def differences(spark_df, con, sql: str) -> list[str]:
    got = normal(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want = normal([d[0] for d in cur.description], cur.fetchall())
    problems = []
    if got[0] != want[0]:
        return [f"columns {got[0]} != {want[0]}"]
    if len(got[1]) != len(want[1]):
        problems.append(f"rows {len(got[1])} != {len(want[1])}")
    for name, a, b in zip(got[0], got[2], want[2]):
        if a and b and a != b:
            problems.append(f"{name}: {a} != {b}")
    if got[1] != want[1]:
        bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
        problems.append(f"{len(bad)} rows differ, first: {bad[:2]}")
    return problems


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tamiz.session import build_session

    sf_dir = argv[0]
    wanted = argv[1:]
    spark = build_session()
    con = oracle(sf_dir)
    sqls, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            problems = differences(df, con, sqls[name]) if name in sqls else [] if df.count() else ["no rows"]
        except Exception as e:  # report every query, then go on
            problems = [f"{type(e).__name__}: {str(e)[:1500]}"]
        failed += bool(problems)
        mark = "FAIL" if problems else "ok" if name in sqls else "rows"
        print(f"{mark:5}{name:32}{time.time() - start:7.2f}s", *problems, flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
