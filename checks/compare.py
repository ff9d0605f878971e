"""Run registered queries and their SQL on the same tables and compare the results.

    python -m checks.compare [folder] [name ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, datetime.datetime):
        return "timestamp"
    return type(value).__name__


def cell(value):
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple((kind(row[i]), cell(row[i])) for i in order) for row in rows)


def compare(spark, con, query, sql: str, folder: str) -> tuple[bool, str]:
    ours = query(spark, folder)
    result = ours.collect()
    theirs = con.execute(sql)
    names = [column[0] for column in theirs.description]
    other = theirs.fetchall()
    if sorted(ours.columns) != sorted(names):
        return False, f"columns {sorted(ours.columns)} != {sorted(names)}"
    mine, expected = rows_of(ours.columns, result), rows_of(names, other)
    if mine == expected:
        return True, f"{len(result)} rows"
    only_mine, only_expected = mine - expected, expected - mine
    first = sorted(map(str, only_mine))[:2], sorted(map(str, only_expected))[:2]
    return False, (
        f"{len(result)} vs {len(other)} rows, {sum(only_mine.values())} differ\n"
        f"   columns {sorted(names)}\n   spark {first[0]}\n   sql   {first[1]}"
    )


def main(arguments: list[str]) -> int:
    from checks.registry import ORACLES, QUERIES
    from checks import cleaning_queries, dashboard_queries, file_queries, report_queries  # noqa: F401
    from orderlens import build_session

    folder = "/root/testdata/sf0.001"
    if arguments and "/" in arguments[0]:
        folder = arguments.pop(0)
    spark = build_session(
        "compare", "local[8]", **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
            "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
        }
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = []
    for name in arguments or list(QUERIES):
        started = time.time()
        try:
            same, note = compare(spark, con, QUERIES[name], ORACLES[name], folder)
        except Exception as error:  # noqa: BLE001
            same, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if same else 'FAIL'} {time.time() - started:5.1f}s {name}: {note}", flush=True)
        if not same:
            failed.append(name)
    print(f"{len(failed)} failed: {' '.join(failed)}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
