"""Compare registered queries with their SQL on the same tables.

Usage: python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()
SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def difference(spark, connection, folder: str, name: str) -> str | None:
    """None if columns and rows agree, else what differs."""
    frame = entry.queries()[name](spark, folder)
    columns = sorted(frame.columns)
    expected = connection.sql(entry.oracle_sql()[name])
    if sorted(expected.columns) != columns:
        return f"columns {columns} and {sorted(expected.columns)}"
    kinds = {field.name: SQL_TYPES[field.dataType.simpleString()] for field in frame.schema}
    types = {column: str(kind) for column, kind in zip(expected.columns, expected.types)}
    if kinds != types:
        return f"types {kinds} and {types}"
    ours = sorted((tuple(row) for row in frame.select(*columns).collect()), key=repr)
    quoted = ", ".join(f'"{column}"' for column in columns)
    theirs = sorted(connection.sql(f"SELECT {quoted} FROM ({entry.oracle_sql()[name]})").fetchall(), key=repr)
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    for left, right in zip(ours, theirs):
        if left != right:
            return f"{columns}: {left} and {right}"
    return None


def main() -> int:
    from pageloom.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    bad = 0
    for name in sys.argv[2:] or entry.queries():
        start = time.time()
        try:
            found = difference(spark, connection, folder, name)
        except Exception as error:  # report and go on with the other queries
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        print(f"{name}: {'same' if found is None else found[:900]} ({time.time() - start:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
