"""Run registered queries beside their SQL and compare all rows.

    python tests/compare.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from datetime import date, datetime
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# types that count as the same
_KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(df, sql: str, connection) -> str | None:
    """What differs between a Spark result and its SQL, or None."""
    result = connection.execute(sql)
    expected_types = {d[0]: str(d[1]) for d in result.description}
    expected = rows_of(list(expected_types), result.fetchall())
    actual_types = {name: _KINDS.get(kind, kind) for name, kind in df.dtypes}
    if actual_types != expected_types:
        return f"schema {actual_types} instead of {expected_types}"
    actual = rows_of(df.columns, df.collect())
    if actual != expected:
        more, less = actual - expected, expected - actual
        return (
            f"{sum(actual.values())} rows instead of {sum(expected.values())}; "
            f"extra {list(more)[:3]}; missing {list(less)[:3]}"
        )
    return None


def main(folder: str, wanted: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as contract
    from learnlens.session import build_session

    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql = connect(folder), contract.oracle_sql()
    failed = 0
    for name, run in contract.queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            df = run(spark, folder)
            if name in sql:
                problem = difference(df, sql[name], connection)
                verdict = "ok" if problem is None else f"DIFFERS {problem}"
            else:
                verdict = f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001
            verdict = f"ERROR {str(error)[:600]}"
        failed += verdict.startswith(("DIFFERS", "ERROR"))
        print(f"{time.time() - started:6.2f}s {name}: {verdict}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
