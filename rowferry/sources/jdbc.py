"""Database tables through Spark's JDBC reader and writer.

The drivers of MySQL, SQL Server and PostgreSQL are the user's to supply (``spark.jars``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.operators.chunks import even_ends
from rowferry.spec import Connection, SpecError

# Fixed values.
DEFAULT_PORTS = {"MYSQL": 3306, "POSTGRESQL": 5432, "MSSQL": 1433}
DRIVERS = {
    "MYSQL": "com.mysql.cj.jdbc.Driver",
    "POSTGRESQL": "org.postgresql.Driver",
    "MSSQL": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
}
FETCH_ROWS = 10_000


def _flag(value: Any) -> str:
    return str(value).lower()


def jdbc_options(connection: Connection) -> dict[str, str]:
    """Reader options of a database connection: url, user, password, driver."""
    if connection.kind not in DRIVERS:
        raise SpecError(f"{connection.kind} is not a database connection")
    parts = urlsplit(connection.location)
    database = unquote(parts.path.lstrip("/"))
    if not database:
        raise SpecError(f"{connection.kind} connection string names no database")
    host = f"{parts.hostname or 'localhost'}:{parts.port or DEFAULT_PORTS[connection.kind]}"
    extra = connection.options.get("driver_options") or {}
    if connection.kind == "MYSQL":
        url = f"jdbc:mysql://{host}/{database}"
        if "ssl_enabled" in extra:
            url += f"?sslMode={'REQUIRED' if extra['ssl_enabled'] else 'DISABLED'}"
    elif connection.kind == "POSTGRESQL":
        url = f"jdbc:postgresql://{host}/{database}"
        if "sslmode" in extra:
            url += f"?sslmode={extra['sslmode']}"
    else:
        url = f"jdbc:sqlserver://{host};databaseName={database}"
        if "encrypt" in extra:
            url += f";encrypt={_flag(extra['encrypt'])}"
        if "trust_server_certificate" in extra:
            url += f";trustServerCertificate={_flag(extra['trust_server_certificate'])}"
    options = {"url": url, "driver": DRIVERS[connection.kind]}
    if parts.username:
        options["user"] = unquote(parts.username)
    if parts.password:
        options["password"] = unquote(parts.password)
    return options


def key_ranges(key: str, lo: int, hi: int, parts: int, ends: Sequence[int] = ()) -> list[str]:
    """At most ``parts`` predicates that together cover every row once: keys up to ``hi`` in ranges of equal
    width, or up to the keys in ``ends``; the first also takes lesser and NULL keys, the last also greater ones."""
    if parts < 2 or hi <= lo:
        return ["1 = 1"]
    size = -(-(hi - lo + 1) // parts)
    cuts = sorted({end + 1 for end in ends if lo <= end < hi}) if ends else list(range(lo + size, hi + 1, size))
    if not cuts:
        return ["1 = 1"]
    return [f"{key} < {cuts[0]} OR {key} IS NULL",
            *[f"{key} >= {a} AND {key} < {b}" for a, b in zip(cuts, cuts[1:])],
            f"{key} >= {cuts[-1]}"]


def read_table(
    spark: SparkSession, connection: Connection, schema: str | None, table: str, *,
    key: str | None = None, parts: int = 1, part_rows: int | None = None, even: bool = False,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A whole table; with ``key`` and ``parts`` it is read in key ranges, one task each.

    The least and greatest key come from one small query. Filters and the columns that are used
    reach the database. ``part_rows`` has that query count the rows as well, and takes as many ranges of
    about so many rows as that needs, ``parts`` at most. ``even`` is for keys that are dense in places: the key column alone is read first, in
    ranges of equal width, and a quantile sketch of it gives ranges of about equal numbers of rows.
    """
    name = f"{schema}.{table}" if schema else table
    reader = {"fetchsize": str(FETCH_ROWS), **jdbc_options(connection), **(options or {})}
    if not key or parts < 2:
        return spark.read.format("jdbc").options(**reader, dbtable=name).load()
    found = f"SELECT MIN({key}) AS lo, MAX({key}) AS hi, {'COUNT(*)' if part_rows else '0'} AS n FROM {name}"
    lo, hi, rows = (spark.read.format("jdbc").options(**reader, query=found).load()
                    .select(*[F.col(c).cast("bigint") for c in ("lo", "hi", "n")]).first())
    properties = {k: v for k, v in reader.items() if k != "url"}

    def within(ranges: list[str]) -> DataFrame:
        return spark.read.jdbc(reader["url"], name, predicates=ranges, properties=properties)

    return within(read_ranges(key, lo, hi, rows, parts, part_rows, even, lambda ranges: within(ranges).select(key)))


def read_ranges(
    key: str, lo: int | None, hi: int | None, rows: int, parts: int, part_rows: int | None, even: bool,
    keys: Callable[[list[str]], DataFrame],
) -> list[str]:
    """The predicates of a partitioned read. ``keys`` reads the key column alone in the ranges it is given."""
    if lo is None or hi is None:
        return ["1 = 1"]
    if part_rows:
        parts = min(parts, -(-rows // part_rows))
    ranges = key_ranges(key, lo, hi, parts)
    if not even or len(ranges) < 2:
        return ranges
    return key_ranges(key, lo, hi, parts, even_ends(keys(ranges), key, parts))


def range_number(key: Column, ranges: Sequence[str]) -> Column:
    """Which of the ``key_ranges`` a row falls in, for checking them on any table."""
    hits = [F.when(F.expr(r), F.lit(i)) for i, r in enumerate(ranges)]
    return F.coalesce(*hits).cast("bigint")


def append_table(df: DataFrame, connection: Connection, schema: str | None, table: str) -> None:
    """Insert rows into an existing database table."""
    name = f"{schema}.{table}" if schema else table
    (df.write.format("jdbc").options(**jdbc_options(connection), dbtable=name, batchsize=str(FETCH_ROWS))
     .mode("append").save())
