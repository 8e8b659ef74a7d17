"""Row errors, batch metrics and the report of a run."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.operators.conflict import NULL_KEY, has_key
from rowferry.operators.shape import ERRORS, IDENTITY, KEY_TEXT, MALFORMED

LEDGER_SCHEMA = (
    "blueprint_sequence int, batch_number bigint, row_identity map<string,string>, error_code string, "
    "message string, target_column string, raw_value string")
METRICS_SCHEMA = "blueprint_sequence int, batch_number bigint, rows_processed bigint, duration_ms double"


def row_errors(evaluated: DataFrame, sequence: int, batch: int = 0) -> DataFrame:
    """One row per error found by ``evaluate``."""
    number = F.col("_batch") if "_batch" in evaluated.columns else F.lit(batch)
    return (evaluated.filter(F.col(ERRORS).isNotNull()).select(
                F.lit(sequence).cast("int").alias("blueprint_sequence"),
                number.cast("bigint").alias("batch_number"),
                F.col(IDENTITY).alias("row_identity"), F.explode(ERRORS).alias("e"))
            .select("blueprint_sequence", "batch_number", "row_identity",
                    "e.error_code", "e.message", "e.target_column", "e.raw_value"))


def key_errors(evaluated: DataFrame, sequence: int, keys: Sequence[str], batch: int = 0) -> DataFrame:
    """One row per evaluated row that no policy can load because a key column is NULL."""
    number = F.col("_batch") if "_batch" in evaluated.columns else F.lit(batch)
    return evaluated.filter(~has_key(keys)).select(
        F.lit(sequence).cast("int").alias("blueprint_sequence"), number.cast("bigint").alias("batch_number"),
        F.col(IDENTITY).alias("row_identity"), F.lit(NULL_KEY).alias("error_code"),
        F.lit("A key column has no value").alias("message"),
        F.concat_ws(",", *[F.when(F.col(k).isNull(), F.lit(k)) for k in keys]).alias("target_column"),
        F.lit(None).cast("string").alias("raw_value"))


def joined_errors(frames: Mapping[str, DataFrame], aliases: Sequence[str], sequence: int) -> DataFrame | None:
    """One row per malformed record of the joined sources that list them, whether or not it met a root
    row; None if no source does. The identity is the source's alias and the record."""
    found = []
    for alias in aliases:
        if MALFORMED in frames[alias].columns:
            record = F.col(MALFORMED)
            # a record is told malformed only when its cells are asked for as well
            whole = F.length(F.concat_ws("", *[F.col(f"`{c}`") for c in frames[alias].columns])) >= 0
            found.append(frames[alias].filter(record.isNotNull() & whole).select(
                F.lit(sequence).cast("int").alias("blueprint_sequence"), F.lit(0).cast("bigint").alias("batch_number"),
                F.create_map(F.lit(alias), record).alias("row_identity"), F.lit("MALFORMED_RECORD").alias("error_code"),
                F.lit("Not as many cells as the header").alias("message"),
                F.lit(None).cast("string").alias("target_column"), record.alias("raw_value")))
    return functools.reduce(DataFrame.unionByName, found) if found else None


def loadable(evaluated: DataFrame, *, reject_bad_rows: bool = False) -> DataFrame:
    """The rows to load: all of them with NULL for lost values, or only those without an error."""
    rows = evaluated.filter(F.col(ERRORS).isNull()) if reject_bad_rows else evaluated
    return rows.drop(ERRORS, IDENTITY, KEY_TEXT)


class RowErrors(Exception):
    """A step with policy FAIL found rows it cannot load."""


def stop_on_errors(ledger: DataFrame) -> None:
    """Raise RowErrors if the ledger has an entry. Fetches one entry at most."""
    found = ledger.limit(1).collect()
    if found:
        raise RowErrors(str(found[0].asDict()))


def batch_metrics(spark: SparkSession, sequence: int, batch: int, rows: int, duration_ms: float) -> DataFrame:
    return spark.createDataFrame([(sequence, batch, rows, float(duration_ms))], METRICS_SCHEMA)


def rows_per_batch(staged: DataFrame, sequence: int) -> DataFrame:
    """Rows per batch or chunk of a staged step, read from its batch column alone."""
    return (staged.groupBy(F.col("_batch").alias("batch_number"))
            .agg(F.count(F.lit(1)).alias("rows_processed"))
            .select(F.lit(sequence).cast("int").alias("blueprint_sequence"), "batch_number", "rows_processed"))


def execution_report(
    migration_id: str, metrics: DataFrame, ledger: DataFrame, *,
    steps: int | None = None, failed: bool = False, message: str = "",
) -> DataFrame:
    """One row: success, completed steps, rows, batches and errors.

    ``error_counts`` has the number of errors per step and code; the entries themselves stay in the
    ledger, which may be large.
    """
    done = metrics.agg(
        F.count_distinct("blueprint_sequence").alias("blueprints_completed"),
        F.coalesce(F.sum("rows_processed"), F.lit(0)).cast("bigint").alias("rows_processed"),
        F.count(F.lit(1)).alias("batches_processed"))
    codes = ledger.groupBy("blueprint_sequence", "error_code").agg(F.count(F.lit(1)).alias("errors"))
    listed = F.sort_array(F.collect_list(F.struct("blueprint_sequence", "error_code", "errors")))
    counts = codes.agg(
        F.coalesce(F.sum("errors"), F.lit(0)).cast("bigint").alias("n"), listed.alias("l"))
    complete = F.lit(not failed)
    if steps is not None:
        complete = complete & (F.col("blueprints_completed") == steps)
    return done.select(
        F.lit(migration_id).alias("migration_id"), complete.alias("success"),
        "blueprints_completed", "rows_processed", "batches_processed",
        counts.select("n").scalar().alias("row_error_count"),
        counts.select("l").scalar().alias("error_counts"),
        F.lit(message).alias("message"))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)

