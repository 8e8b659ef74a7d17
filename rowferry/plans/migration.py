"""A whole migration: its steps in order."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from rowferry.operators import ledger as ledgers
from rowferry.operators.conflict import KeyConflict
from rowferry.plans.blueprint import LEDGER, StepResult, load_step, stage_step
from rowferry.sinks.tables import TableStore
from rowferry.sources.open import open_sources
from rowferry.spec import Migration, Step, Target

METRICS = ("migration_admin", "batch_metrics")


@dataclass
class MigrationRun:
    """What a run did. ``report`` has one row; the ledger and metrics are tables of the store."""

    run_id: str
    results: list[StepResult]
    report: DataFrame
    failure: Exception | None = None


def run_migration(
    spark: SparkSession, migration: Migration, store: TableStore, *,
    run_id: str | None = None,
    sources: Callable[[Step], Mapping[str, DataFrame]] | None = None,
    read_options: Mapping[str, Mapping] | None = None,
    at: datetime | None = None,
    reject_bad_rows: bool = False,
    log_batch_duplicates: bool = False,
    commits: int | None = None,
    lower: int | None = None,
    watch: Sequence[str] = (),
    check_null: bool = False,
    check_length: bool = False,
    targets: Callable[[Step], object] | None = None,
    raise_on_failure: bool = True,
) -> MigrationRun:
    """Run the steps in order; when step N fails, 1..N-1 stay loaded.

    Called again with the same ``run_id`` after a failure, it goes on where it stopped: a step
    whose target version carries the run's tag is not loaded again. Targets are tables of
    ``store`` unless ``targets`` says where a step's target is. ``commits``, ``lower`` and
    ``watch`` concern chunked steps (see ``stage_step`` and ``chunk_bounds``). ``check_null`` and ``check_length`` list
    missing values of columns that are not nullable, and texts that are too long. The staged rows of a step are
    deleted once they are loaded, or refused by a FAIL policy; after any other failure they stay for
    the run to go on with.
    """
    run_id = re.sub(r"[^\w-]", "_", run_id) if run_id else uuid.uuid4().hex[:12]
    results: list[StepResult] = []
    failure: Exception | None = None
    for step in migration.steps:
        target, tag = step.target, f"{run_id}-step{step.order}"
        tables = targets(step) if targets else store
        if tables.has_tag(target.schema, target.table, f"{tag}-load"):
            results.append(StepResult(step.order, skipped=True))
            continue
        name = f"{run_id}_step{step.order}"
        try:
            frames = sources(step) if sources else open_sources(spark, step, migration.connections, read_options)
            staged, batches = stage_step(
                spark, step, frames, store, name, commits=commits, lower=lower, watch=watch, tag=f"{tag}-",
                check_null=check_null, check_length=check_length)
            result = load_step(
                spark, step, staged, store, migration_id=migration.migration_id, tag=run_id, at=at,
                reject_bad_rows=reject_bad_rows, log_batch_duplicates=log_batch_duplicates, tables=tables,
                collation=_collation(migration, target),
                source_errors=ledgers.joined_errors(frames, [j.source.alias for j in step.joins], step.order))
            result.batches, result.rows_read = batches, sum(b[1] for b in batches)
            metrics = spark.createDataFrame(
                [(step.order, batch, rows, ms) for batch, rows, ms in batches], ledgers.METRICS_SCHEMA)
            store.publish(*METRICS, metrics, mode="add", tag=f"{tag}-metrics")
        except Exception as error:  # noqa: BLE001 - the steps before stay, the report says which failed
            failure = error
            if isinstance(error, (KeyConflict, ledgers.RowErrors)):
                _drop_staged(store, name)
            results.append(StepResult(step.order))
            if raise_on_failure:
                raise
            break
        _drop_staged(store, name)
        results.append(result)
    return MigrationRun(run_id, results, report(spark, migration, store, run_id, failure), failure)


def _collation(migration: Migration, target: Target) -> str | None:
    """What the connection of a target compares its text keys under."""
    connection = migration.connections.get(target.connection) if target.connection else None
    return connection.options.get("collation") if connection else None


def _drop_staged(store: TableStore, name: str) -> None:
    store.drop("staging", name)
    store.drop("staging", f"{name}_ranges")


def report(
    spark: SparkSession, migration: Migration, store: TableStore, run_id: str, failure: Exception | None = None,
) -> DataFrame:
    """The execution report of a run from its metrics and ledger tables."""
    metrics = _of_run(spark, store, METRICS, run_id, ledgers.METRICS_SCHEMA)
    errors = _of_run(spark, store, LEDGER, run_id, ledgers.LEDGER_SCHEMA)
    message = f"{type(failure).__name__}: {failure}".splitlines()[0] if failure else ""
    return ledgers.execution_report(
        migration.migration_id, metrics, errors, steps=len(migration.steps),
        failed=failure is not None, message=message)


def _of_run(spark: SparkSession, store: TableStore, table: tuple[str, str], run_id: str, schema: str) -> DataFrame:
    own = re.compile(rf"{re.escape(run_id)}-step\d+-(errors|metrics)")
    paths = [v.path for v in store.versions(*table) if v.tag and own.fullmatch(v.tag)]
    return spark.read.schema(schema).parquet(*paths) if paths else ledgers.empty(spark, schema)
