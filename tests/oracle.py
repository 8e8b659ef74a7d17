"""Compare a Spark result with the result of SQL in DuckDB, as sets of rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import os
from collections import Counter

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, bool):
        return ("bool", value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql) -> str:
    """'' when both agree, else what differs."""
    names, got = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    wanted_names, wanted = rows_of([d[0] for d in result.description], result.fetchall())
    if names != wanted_names:
        return f"columns {names} but SQL has {wanted_names}"
    if got == wanted:
        return ""
    extra, missing = got - wanted, wanted - got
    return (f"{sum(got.values())} rows, SQL has {sum(wanted.values())}; {sum(extra.values())} only in Spark, "
            f"{sum(missing.values())} only in SQL\n  Spark: {list(extra)[:3]}\n  SQL:   {list(missing)[:3]}")
