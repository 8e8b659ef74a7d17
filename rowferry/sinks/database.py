"""Target tables in a database, through Spark's JDBC reader and writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rowferry.sources.jdbc import append_table, read_table
from rowferry.spec import Connection, Migration, Step


class DatabaseTables:
    """Existing tables of one database in the place of a ``TableStore``, for loads that add rows.

    Spark's writer inserts; it cannot update. So FAIL and the IGNORE policies work, and UPSERT as
    long as no key of the batch is in the target. A repeated load under an IGNORE policy skips the
    rows that are there already.
    """

    def __init__(self, spark: SparkSession, connection: Connection) -> None:
        self.spark, self.connection = spark, connection

    def exists(self, schema: str, table: str) -> bool:
        return True

    def has_tag(self, schema: str, table: str, tag: str) -> bool:
        return False

    def read(self, schema: str, table: str) -> DataFrame:
        return read_table(self.spark, self.connection, schema, table)

    def publish(self, schema: str, table: str, rows: DataFrame, *, mode: str = "add", tag: str | None = None) -> int:
        if mode != "add":
            raise NotImplementedError(
                f"{schema}.{table} has keys of this batch; replacing rows of a database table needs an UPDATE there")
        written = Observation()
        append_table(rows.observe(written, F.count(F.lit(1)).alias("rows")), self.connection, schema, table)
        return written.get.get("rows", 0)


def database_targets(spark: SparkSession, migration: Migration):
    """For ``run_migration(targets=...)``: each step loads into the database its target names."""
    def of(step: Step) -> DatabaseTables:
        return DatabaseTables(spark, migration.connections[step.target.connection])
    return of
