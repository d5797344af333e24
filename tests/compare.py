"""Run registered queries beside their checking SQL: ``python -m tests.compare [keys…]``."""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, int):
        return ("i", value)
    if isinstance(value, float):
        return ("f", "nan" if math.isnan(value) else value)
    if value is None:
        return ("n", "")
    return (type(value).__name__, str(value))


def normal(columns, rows):
    """Columns by name, rows in any order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([_cell(row[i]) for i in order]) for row in rows)


def compare(spark, con, key, fn, sql, folder):
    """Empty string when both sides agree, otherwise what differs."""
    frame = fn(spark, folder)
    mine = normal(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return "" if mine[1] else "no rows"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    other = normal(names, result.fetchall())
    if mine[0] != other[0]:
        return f"columns {mine[0]} != {other[0]}"
    if len(mine[1]) != len(other[1]):
        return f"rows {len(mine[1])} != {len(other[1])}"
    bad = [(a, b) for a, b in zip(mine[1], other[1]) if a != b]
    return f"{len(bad)} of {len(mine[1])} rows differ, first:\n  {bad[0][0][:400]}\n  {bad[0][1][:400]}" if bad else ""


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from corpusloom.session import build_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    keys = sys.argv[1:] or list(queries)
    failed = []
    for key in keys:
        start = time.time()
        try:
            verdict = compare(spark, con, key, queries[key], sqls.get(key), folder)
        except Exception as error:  # noqa: BLE001
            verdict = f"{type(error).__name__}: {str(error)[:700]}"
        kind = "sql" if key in sqls else "rows"
        print(f"{'ok  ' if not verdict else 'FAIL'} {key} [{kind}] {time.time() - start:.1f}s {verdict}", flush=True)
        if verdict:
            failed.append(key)
    print(f"{len(keys) - len(failed)} of {len(keys)} ok; failed: {failed}")


if __name__ == "__main__":
    main()
