"""Tables for refused rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.casts import fitted
from rowferry.spec import Target

SNAPSHOT = "_snapshot"  # the uncast key values of a row as a struct

# The columns an audit table has besides those of its target.
STAMPS = [
    ("rejected_at", T.TimestampType()), ("logged_at", T.TimestampType()),
    ("migration_id", T.StringType()), ("blueprint_sequence", T.IntegerType()),
    ("target_schema", T.StringType()), ("target_table", T.StringType()),
]
DETAILS = [
    ("source_snapshot", T.StringType()), ("reject_reason", T.StringType()), ("raw_row", T.StringType()),
]


def audit_layout(target: T.StructType, keys: Sequence[str]) -> T.StructType:
    """Target columns, stamps, key columns the target lacks (as text), details."""
    names = [f.name for f in target.fields]
    extra = [(k, T.StringType()) for k in keys if k not in names]
    plain = [(f.name, f.dataType) for f in target.fields]
    return T.StructType([T.StructField(n, t, True) for n, t in [*plain, *STAMPS, *extra, *DETAILS]])


def unprocessed_layout(target: T.StructType) -> T.StructType:
    """Target columns and ``rejected_at``."""
    return T.StructType([*target.fields, T.StructField("rejected_at", T.TimestampType(), True)])


def _now(at: datetime | None) -> Column:
    return F.lit(at).cast("timestamp") if at else F.current_timestamp()


def audit_rows(
    rejects: DataFrame, columns: Sequence[str], migration_id: str, sequence: int, target: Target,
    at: datetime | None = None,
) -> DataFrame:
    """Rejects as rows of an audit table: mapped columns, when, where, why, and the row as JSON."""
    as_json = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    if SNAPSHOT in rejects.columns:
        snapshot = as_json(F.col(SNAPSHOT))
    else:
        snapshot = as_json(F.struct(*target.keys)) if target.keys else F.lit(None).cast("string")
    return rejects.select(
        *columns, _now(at).alias("rejected_at"), _now(at).alias("logged_at"),
        F.lit(migration_id).alias("migration_id"), F.lit(sequence).cast("int").alias("blueprint_sequence"),
        F.lit(target.schema).alias("target_schema"), F.lit(target.table).alias("target_table"),
        snapshot.alias("source_snapshot"), "reject_reason",
        as_json(F.struct(*columns)).alias("raw_row"))


def unprocessed_rows(rejects: DataFrame, columns: Sequence[str], at: datetime | None = None) -> DataFrame:
    return rejects.select(*columns, _now(at).alias("rejected_at"))


def fit(rows: DataFrame, layout: T.StructType) -> DataFrame:
    """The rows with exactly the columns of a table; what they lack, or what does not fit, is NULL."""
    have = {f.name: f.dataType for f in rows.schema.fields}
    return rows.select(*[
        (fitted(F.col(f.name), f.dataType, have[f.name]) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in layout.fields])
