"""A private, stable copy of a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowferry.sinks.tables import TableStore
from rowferry.workspace import fresh_folder


def stage(spark: SparkSession, df: DataFrame, name: str, store: TableStore | None = None) -> DataFrame:
    """Write ``df`` once and read it back.

    Without a ``store`` the copy is private. In a store, staging under the same name again replaces
    the copy and deletes the one before. Needed where a source may change during a run or is costly to read twice. It also cuts the
    lineage: a lost executor costs a re-read of the copy, not of the source.
    """
    store = store or TableStore(spark, fresh_folder(spark, "staged"))
    store.publish("staging", name, df)
    store.drop_old_versions("staging", name)
    return store.read("staging", name)
