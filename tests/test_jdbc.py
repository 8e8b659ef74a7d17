"""Reader options only: no database is started."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rowferry.sinks.database import DatabaseTables
from rowferry.sources.jdbc import jdbc_options, key_ranges, range_number, read_ranges, read_table
from rowferry.spec import Connection, SpecError


def options(kind, url, **driver_options):
    return jdbc_options(Connection(kind, url, {"driver_options": driver_options} if driver_options else {}))


def test_mysql():
    got = options("MYSQL", "mysql://read_user:p%40ss@crm/crm_db", ssl_enabled=False)
    assert got == {"url": "jdbc:mysql://crm:3306/crm_db?sslMode=DISABLED", "driver": "com.mysql.cj.jdbc.Driver",
                   "user": "read_user", "password": "p@ss"}


def test_sql_server():
    got = options("MSSQL", "sqlserver://u:p@billing:1444/finance_db", encrypt=True, trust_server_certificate=False)
    assert got["url"] == "jdbc:sqlserver://billing:1444;databaseName=finance_db;encrypt=true;trustServerCertificate=false"
    assert options("MSSQL", "sqlserver://u:p@billing/f")["url"] == "jdbc:sqlserver://billing:1433;databaseName=f"


def test_postgresql():
    assert options("POSTGRESQL", "postgresql://u@pos/logs", sslmode="prefer") == {
        "url": "jdbc:postgresql://pos:5432/logs?sslmode=prefer", "driver": "org.postgresql.Driver", "user": "u"}


def test_refused():
    with pytest.raises(SpecError):
        options("MYSQL", "mysql://u:p@host")
    with pytest.raises(SpecError):
        options("PARQUET", "x://h/d")


@pytest.mark.parametrize("lo,hi,parts", [(0, 99, 4), (5, 5, 3), (-10, 10, 7), (0, 2, 8), (1, 100, 1)])
def test_ranges_cover_every_row_once(spark, lo, hi, parts):
    ranges = key_ranges("k", lo, hi, parts)
    assert len(ranges) <= max(parts, 1)
    keys = spark.range(lo - 3, hi + 4).select(F.col("id").alias("k")).union(spark.sql("select cast(null as bigint)"))
    hits = [F.when(F.expr(r), 1).otherwise(0) for r in ranges]
    assert keys.filter(sum(hits[1:], hits[0]) != 1).count() == 0
    assert keys.filter(range_number(F.col("k"), ranges).isNull()).count() == 0


def test_database_targets_only_add(spark):
    tables = DatabaseTables(spark, Connection("MYSQL", "mysql://u:p@h/d"))
    with pytest.raises(NotImplementedError):
        tables.publish("s", "t", spark.range(1), mode="full")


def test_a_chunked_root_is_read_in_ranges_of_its_chunk_column(spark, monkeypatch):
    from rowferry.sources import open as opening
    from rowferry.spec import Chunking, ColumnMap, Condition, Join, Source, Step, Target
    asked = {}
    monkeypatch.setattr(opening, "read_table", lambda spark, c, schema, table, **o: asked.setdefault(table, o))
    s = Step(1, Target("s", "t", ()), Source("h", "db", "headers", "dbo"),
             (ColumnMap("id", "DIRECT", "h.id", "BIGINT"),),
             joins=(Join(Source("l", "db", "lines", "dbo"), (Condition("l.hid", "=", "h.id"),)),),
             chunking=Chunking("h.id", 25000))
    places = {"db": Connection("MSSQL", "sqlserver://u:p@h/d")}
    opening.open_sources(spark, s, places, {"l": {"key": "line_id", "parts": 8}})
    assert asked == {"headers": {"key": "id", "parts": opening.READ_PARTS}, "lines": {"key": "line_id", "parts": 8}}


@pytest.mark.parametrize("ends,count", [((3, 3, 7), 3), ((-50, 99, 200), 1), ((0, 1, 98), 4), ((), 4)])
def test_ranges_up_to_given_keys_cover_every_row_once(spark, ends, count):
    ranges = key_ranges("k", 0, 99, 4, ends)
    assert len(ranges) == count
    keys = spark.range(-3, 104).select(F.col("id").alias("k")).union(spark.sql("select cast(null as bigint)"))
    hits = [F.when(F.expr(r), 1).otherwise(0) for r in ranges]
    assert keys.filter(sum(hits[1:], hits[0]) != 1).count() == 0


def test_even_ranges_and_ranges_by_rows(spark):
    """9,000 of 10,000 keys lie in the lowest hundredth; one key has a tenth of the rows."""
    keys = spark.range(10_000).select(F.expr("case when id < 1000 then 5 when id < 9000 then id else id * 100 end").alias("k"))
    lo, hi, n = 5, 999_900, 10_000
    asked = []

    def read(ranges):
        asked.append(ranges)
        return keys.where(" OR ".join(f"({r})" for r in ranges))

    largest = lambda ranges: max(r["count"] for r in keys.groupBy(range_number(F.col("k"), ranges)).count().collect())
    assert largest(read_ranges("k", lo, hi, n, 8, None, False, read)) == 9000 and not asked
    even = read_ranges("k", lo, hi, n, 8, None, True, read)
    assert len(even) == 8 and largest(even) <= 1300 and asked == [key_ranges("k", lo, hi, 8)]
    assert len(read_ranges("k", lo, hi, n, 64, 2500, False, read)) == 4
    assert read_ranges("k", lo, hi, n, 64, 20_000, True, read) == ["1 = 1"] == read_ranges("k", None, None, 0, 64, 10, True, read)


def test_a_table_is_read_by_its_bounds(monkeypatch):
    """The calls a read makes: bounds with a count, the key column alone, then the ranges."""
    class Reader:
        def __init__(self):
            self.calls = []

        def format(self, kind):
            return self

        def options(self, **given):
            self.calls.append(given["query"])
            return self

        def load(self):
            return self

        def select(self, *columns):
            return self

        def first(self):
            return (1, 100, 5_000)

        def jdbc(self, url, name, predicates, properties):
            self.calls.append(predicates)
            return self

    reader = Reader()
    monkeypatch.setattr("rowferry.sources.jdbc.even_ends", lambda df, key, parts: [2, 4, 6, 8][:parts - 1])
    monkeypatch.setattr("rowferry.sources.jdbc.F.col", lambda name: type("Column", (), {"cast": lambda self, kind: name})())
    read_table(type("Session", (), {"read": reader})(), Connection("MYSQL", "mysql://u:p@h/d"), "s", "t",
               key="k", parts=64, part_rows=1_000, even=True)
    assert reader.calls == ["SELECT MIN(k) AS lo, MAX(k) AS hi, COUNT(*) AS n FROM s.t", key_ranges("k", 1, 100, 5),
                            key_ranges("k", 1, 100, 5, [2, 4, 6, 8])]
