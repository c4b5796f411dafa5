"""Compare a Spark result with the oracle's, value by value."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("set TimeZone = 'UTC'")
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{Path(sf_dir) / (table + '.parquet')}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def differences(spark_rows: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when column names, types and the multiset of rows agree."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    if sorted(names) != sorted(spark_rows.columns):
        return [f"columns: spark {sorted(spark_rows.columns)} oracle {sorted(names)}"]
    order = sorted(names)
    out = []
    for name, kind in spark_rows.dtypes:
        if KINDS.get(kind, kind) != types[name] and not (types[name] == "STRING" and kind == "string"):
            out.append(f"type of {name}: spark {kind} oracle {types[name]}")
    position = [names.index(n) for n in order]
    theirs = Counter(tuple(_plain(row[i]) for i in position) for row in result.fetchall())
    mine = Counter(tuple(_plain(row[n]) for n in order) for row in spark_rows.collect())
    if mine != theirs:
        out.append(f"rows: spark {sum(mine.values())} oracle {sum(theirs.values())} of {order}")
        out += [f"only spark: {r}"[:600] for r in list((mine - theirs))[:3]]
        out += [f"only oracle: {r}"[:600] for r in list((theirs - mine))[:3]]
    return out
