"""Run registered queries on Spark and their equivalents on DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return str(value)


SECONDS: dict[str, list[float]] = {}


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def duck(folder: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def compare(spark, connection, folder: str, name: str, query, sql: str | None) -> str:
    """Empty string when the results agree; else what differs."""
    begin = time.time()
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    SECONDS[name] = [time.time() - begin]
    begin = time.time()
    if sql is None:
        return "" if sum(got.values()) else "no rows"
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = rows_of(columns, cursor.fetchall())
    SECONDS[name].append(time.time() - begin)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got != expected:
        extra, missing = list((got - expected).items()), list((expected - got).items())
        return f"{sum(got.values())} vs {sum(expected.values())} rows; spark only {len(extra)}: {str(extra[:2])[:1500]}; duckdb only {len(missing)}: {str(missing[:2])[:1500]}"
    return "" if sum(got.values()) else "no rows on either side"


def main(argv: list[str]) -> int:
    import importlib
    import pathlib

    sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))
    entry = importlib.import_module("__spark_entry__")
    from corpusflow.session import local_session

    folder = argv[0]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv[1:] or any(part in n for part in argv[1:])]
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, connection, folder, name, queries[name], oracles.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {' / '.join(f'{s:6.2f}' for s in SECONDS.get(name, [time.time() - start]))} {name}{'' if name in oracles else ' (no SQL)'} {problem}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
