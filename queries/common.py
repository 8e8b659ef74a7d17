"""Helpers of the query modules."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from rowferry.plans.blueprint import run_blueprint
from rowferry.sinks.tables import TableStore
from rowferry.spec import ColumnMap, Condition, Join, Source, Step, Target


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def maps(*columns: tuple[str, str, str, str]) -> tuple[ColumnMap, ...]:
    """(column, kind, value, type) tuples as mappings."""
    return tuple(ColumnMap(*c) for c in columns)


def join(alias: str, how: str, *conditions: tuple[str, str, str], salted: bool = False) -> Join:
    return Join(Source(alias, "data", alias), tuple(Condition(*c) for c in conditions), how, salted)


def step(root: str, columns, *, keys: Sequence[str] = (), policy: str = "IGNORE", name: str = "result",
         order: int = 1, **parts) -> Step:
    parts = {k: tuple(v) if isinstance(v, list) else v for k, v in parts.items()}
    return Step(order, Target("migrated", name, tuple(keys), policy), Source(root, "data", root),
                tuple(columns), **parts)


def run(s: Step, **frames: DataFrame) -> DataFrame:
    return run_blueprint(s, frames)


def expressions(spark: SparkSession, sf: str, source: str, alias: str, *columns: tuple[str, str, str]) -> DataFrame:
    """Expression mappings (column, text, type) over one table."""
    return run(step(alias, maps(*[(c, "EXPRESSION", text, to) for c, text, to in columns])),
               **{alias: table(spark, sf, source)})


class Interrupted(TableStore):
    """Tables whose loads are disturbed: ``before(schema, table)`` is called ahead of each write, and may
    fail, or write something itself."""

    def __init__(self, spark: SparkSession, root: str, before: Callable[[str, str], None]) -> None:
        super().__init__(spark, root)
        self.before = before

    def publish(self, schema: str, table: str, rows: DataFrame, **options) -> int:
        self.before(schema, table)
        return super().publish(schema, table, rows, **options)


class Died(Exception):
    """The failure that a query makes."""
