"""One step: sources to typed rows, and typed rows into the target."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.casts import spark_type
from rowferry.operators.chunks import chunk_bounds, chunk_number, even_ends, fingerprints, load_ranges, whole
from rowferry.operators.conflict import (
    BATCH, FLAG, POLICIES, has_key, key_flags, keys_compared_as, match_hint, meets_some, met_keys, parted, replaces_rows,
    require_no_conflicts, rows_and_span,
)
from rowferry.operators.joins import join_sources
from rowferry.operators.ledger import key_errors, row_errors, stop_on_errors
from rowferry.operators.shape import ERRORS, KEY_TEXT, MALFORMED, derive, evaluate, fit_target, keep_rows, project
from rowferry.sinks.audit import SNAPSHOT, audit_layout, audit_rows, fit, unprocessed_layout, unprocessed_rows
from rowferry.sinks.tables import Buckets, StaleTable, TableStore
from rowferry.spec import DEFAULT_AUDIT_TABLE, SpecError, Step, Target
from rowferry.workspace import file_system, fresh_folder

CAPTURING = ("IGNORE_AND_LOG", "IGNORE_AND_INSERT_UNPROCESSED")
LEDGER = ("migration_admin", "row_errors")
#: How often parts whose source changed are staged again before the step fails.
RESTAGED = 5


def transformed(step: Step, frames: Mapping[str, DataFrame], *, root_filter: Column | None = None) -> DataFrame:
    """Sources filtered, joined and with derived variables; aliases still name every column."""
    root = frames[step.root.alias].alias(step.root.alias)
    if root_filter is not None:
        root = root.filter(root_filter)
    rows = join_sources(keep_rows(root, step.pre_filters), step.joins, frames)
    return keep_rows(derive(rows, step.derivations), step.post_filters)


def run_blueprint(step: Step, frames: Mapping[str, DataFrame]) -> DataFrame:
    """The rows a step loads: one lazy plan from the sources to the mapped, safely cast columns."""
    return project(transformed(step, frames), step.columns)


def target_layout(step: Step) -> T.StructType:
    """The target columns as the mappings declare them."""
    return T.StructType([T.StructField(c.column, spark_type(c.cast_to), True) for c in step.columns])


@dataclass
class StepResult:
    order: int
    rows_read: int = 0
    rows_loaded: int = 0
    rows_inserted: int = 0
    rows_updated: int = 0
    rejects: int = 0
    errors: int = 0
    batches: list[tuple[int, int, float]] = field(default_factory=list)
    skipped: bool = False


def stage_step(
    spark: SparkSession, step: Step, frames: Mapping[str, DataFrame], store: TableStore, name: str, *,
    commits: int | None = None, tag: str = "", lower: int | None = None, watch: Sequence[str] = (), **checks,
) -> tuple[DataFrame, list[tuple[int, int, float]]]:
    """Evaluate a step into a staged table, and give it with (batch, rows, milliseconds) per write.

    Without chunking, or without ``commits``, this is one job over all rows: tasks already bound
    the memory, and the chunk number is a column. With it, the chunks are written in that many
    ranges, so that a run which is resumed skips the ranges already staged under its tag. Their
    number is the caller's; it does not grow with the data. Staging in one job starts afresh.

    The ranges have about equal numbers of rows. They are kept in the store when the first run draws
    them, and a resumed run reads them there. The last one is open above; keys below the first, NULL
    keys and text keys that are no number are a part of their own. So every root row is in one part
    whatever its key. A part is staged under the number of its root rows and a checksum of their
    keys (and of the root's columns in ``watch``). Both are counted anew when all parts are there: what
    came or went meanwhile, also in a part that an earlier run had finished, has its part staged
    again, and the step fails if the root never stands still.
    """
    def write(batch: int, rows: DataFrame, mark: str | None = None) -> tuple[int, int, float]:
        began = time.monotonic()
        written = store.publish("staging", name, rows, mode="add" if mark else "full", tag=mark)
        return batch, written, (time.monotonic() - began) * 1000

    checks.setdefault("key_text", step.target.policy in CAPTURING)
    if MALFORMED in frames[step.root.alias].columns:
        checks["malformed"] = f"{step.root.alias}.{MALFORMED}"
    chunk = step.chunking
    if chunk is None:
        rows = evaluate(transformed(step, frames), step.columns, step.target.keys,
                        also=[F.lit(0).cast("bigint").alias("_batch")], **checks)
        return _staged(store, name, [write(0, rows)])

    key = F.col(chunk.column)
    root = keep_rows(frames[step.root.alias].alias(step.root.alias), step.pre_filters)
    bounds = chunk_bounds(root, chunk.column, lower).first()
    number = chunk_number(key, bounds["lo"], chunk.size).alias("_batch")

    def part(root_filter: Column | None) -> DataFrame:
        return evaluate(transformed(step, frames, root_filter=root_filter), step.columns,
                        step.target.keys, also=[number], **checks)

    above = None if lower is None else whole(key) > lower
    # a RIGHT or FULL join would give its unmatched rows once per range
    if commits is None or any(j.how in ("RIGHT", "FULL") for j in step.joins):
        return _staged(store, name, [write(0, part(above))])
    if not store.has_tag("staging", f"{name}_ranges", f"{tag}ranges"):
        drawn = load_ranges(bounds["lo"], bounds["hi"], chunk.size, commits, even_ends(root, chunk.column, commits))
        kept = spark.createDataFrame(drawn or [(bounds["lo"], bounds["hi"])], "lo bigint, hi bigint")
        store.publish("staging", f"{name}_ranges", kept, mode="full", tag=f"{tag}ranges")
    ranges = sorted((r["lo"], r["hi"]) for r in store.read("staging", f"{name}_ranges").collect())
    lowest, highest = ranges[0][0], ranges[-1][1]
    # whole keys are compared as they are, so that the filter reaches the scan
    at = key if isinstance(root.select(key).schema[0].dataType, T.IntegralType) else whole(key)
    filters = {i: (at > lo) & (at <= hi) if hi < highest else at > lo for i, (lo, hi) in enumerate(ranges, 1)}
    if lower is None:
        filters[0] = at.isNull() | (at <= lowest)
    done: dict[int, tuple[int, int, float]] = {}
    for _ in range(RESTAGED):
        found = fingerprints(root, chunk.column, ranges, watch)
        marks = {i: f"{tag}b{i}-{found.get(i, '0-0')}" for i in filters}
        there = {v.tag: v.path for v in store.versions("staging", name) if v.tag and v.tag.startswith(f"{tag}b")}
        if done and set(there) == set(marks.values()):
            return store.read("staging", name, list(there.values())), list(done.values())
        store.drop_versions([path for mark, path in there.items() if mark not in marks.values()])
        done.update({i: write(i, part(filters[i]), mark) for i, mark in marks.items() if i not in done or mark not in there})
    raise SourceChanged(f"the source of step {step.order} changes while it is staged")


class SourceChanged(Exception):
    """The rows of a chunked root differ from those that were staged, time and again."""


def _staged(store: TableStore, name: str, done: list) -> tuple[DataFrame, list]:
    return store.read("staging", name), done


def load_step(
    spark: SparkSession, step: Step, staged: DataFrame, store: TableStore, *,
    migration_id: str = "", tag: str = "", at: datetime | None = None, order_by: Sequence[str] = (),
    reject_bad_rows: bool = False, log_batch_duplicates: bool = False, tables=None,
    source_errors: DataFrame | None = None, superseded: Callable[[str], bool] | None = None, collation: str | None = None,
) -> StepResult:
    """Load staged rows under the target's policy.

    ``store`` keeps the error ledger; ``tables`` holds the target if that is elsewhere. ``source_errors``
    are entries of the ledger that belong to no staged row.

    Errors and refused rows are written first, then the target gets its new version, so a load that
    dies half-way leaves the target as it was and can be repeated under the same tag: entries that a
    load without a version has left are deleted and written anew, as other loads may have come between.
    ``superseded`` tells of which further steps' tags that holds. A tag whose load is there is skipped. Values take the
    target's types. FAIL refuses the step when any row has an error; the other policies load such rows
    with NULL for what was lost, or leave them out with ``reject_bad_rows``.

    A target with ``buckets`` is read only where the batch has keys, and written only where it meets some.
    Under a ``collation`` of the target, text keys are compared by it: an updated row keeps the spelling it has, a new one that of
    the row the policy picks. Buckets go by the bytes of a key, so the two exclude each other.
    """
    target, result = step.target, StepResult(step.order)
    if not order_by:  # chunks are loaded as if one after the other
        order_by = [*([BATCH] if step.chunking else []), *target.order_by]
    columns = [c.column for c in step.columns]
    tables = tables or store
    versioned = isinstance(tables, TableStore)
    tag = tag or uuid.uuid4().hex[:12]
    own = f"{tag}-step{step.order}"
    if tables.has_tag(target.schema, target.table, f"{own}-load"):
        return StepResult(step.order, skipped=True)
    there = tables.exists(target.schema, target.table)
    base = tables.newest(target.schema, target.table) if versioned else None
    before = tables.read(target.schema, target.table) if there else spark.createDataFrame([], target_layout(step))
    unknown = [c for c in columns if c not in before.columns]
    if unknown:
        raise SpecError(f"{target.schema}.{target.table} has no columns {unknown}")
    staged = fit_target(staged, before.schema, columns, target.keys)
    ledger = row_errors(staged, step.order)
    if source_errors is not None:
        ledger = ledger.unionByName(source_errors)
    if target.policy == "FAIL":
        stop_on_errors(ledger)
    if target.keys:
        ledger = ledger.unionByName(key_errors(staged, step.order, target.keys))
    rows = staged.filter(F.col(ERRORS).isNull()) if reject_bad_rows else staged
    captures = target.policy in CAPTURING
    snapshot = [F.col(KEY_TEXT).alias(SNAPSHOT)] if captures and KEY_TEXT in staged.columns else []
    batch = rows.select(*columns, *[c for c in order_by if c not in columns], *snapshot)
    options = {"log_batch_duplicates": log_batch_duplicates, "carried": [SNAPSHOT]} if captures else {}
    buckets = Buckets(target.buckets, target.keys) if target.buckets and versioned else None
    kept = there and buckets is not None and tables.layout(target.schema, target.table) == buckets.layout
    if kept:
        before = tables.read(target.schema, target.table, buckets=buckets.of(batch.filter(has_key(target.keys))))
    keys, layout = list(target.keys), before.schema
    if collation and keys:
        if buckets is not None:
            raise SpecError(f"{target.schema}.{target.table} has buckets, so its keys cannot be compared as {collation}")
        keys, (before, batch) = keys_compared_as(collation, keys, before, batch)
        if target.policy == "UPSERT":
            options["stays"] = target.keys
    refused = _reject_table(target)

    def withdraw() -> None:
        for place, at in ((store, LEDGER), (tables, refused)):
            if at and isinstance(place, TableStore):
                _drop_entries(place, *at, lambda t: t == own or superseded is not None and superseded(t))

    # what several jobs need is found once: the keys the target already has, or the fate of each key
    met = found = flags = kept_rows = None
    near = before
    if captures:
        options["flags"], flags = _written(spark, key_flags(before, batch.drop(*options["carried"]), keys, order_by))
    elif there and keys:
        number, span = rows_and_span(batch, keys)
        hint = match_hint(number)
        if buckets is None:  # rows out of reach of the batch's keys are not matched with it
            near, apart = parted(before, span)
            if target.policy == "UPSERT":
                options["apart"] = apart
        if near.isEmpty():
            met = near.select(*keys).limit(0)
        elif (hint == "merge" and target.policy == "UPSERT" and versioned and buckets is None
              and replaces_rows(near, batch, options.get("stays", ())) and meets_some(near, batch, keys)):
            # the target is written anew in any case, so the keys are matched as it is, and counted then
            kept_rows = options["kept_rows"] = Observation()
            options["hint"] = hint
        else:
            found = met_keys(near, batch, keys, hint).persist()
            met = found.hint(hint)  # no more than the batch has
    try:
        load = POLICIES[target.policy](near, batch, keys, order_by, met, **options)
        require_no_conflicts(load)
        withdraw()
        result.errors = store.publish(*LEDGER, ledger, mode="add", tag=f"{own}-errors")
        if captures:
            result.rejects = _keep_rejects(step, load.rejects, layout, tables, migration_id, f"{own}-rejects", at)
        # a load of new keys alone adds its rows and spares the target a rewrite
        result.rows_updated = found.count() if load.rewrites and found is not None else 0
        rewrite = result.rows_updated > 0 or kept_rows is not None
        added, was, how = fit(load.append, layout), 0, {"mode": "add" if there else "full"}
        if kept and rewrite:  # only the buckets that change
            hit = buckets.of(found)
            old = tables.read(target.schema, target.table, buckets=hit)
            changed = POLICIES[target.policy](old, batch.filter(buckets.number().isin(hit)), target.keys, order_by, met)
            added = changed.new_target.unionByName(added.filter(~buckets.number().isin(hit)))
            was, how = old.count(), {"mode": "part", "buckets": buckets, "replaced": hit}
        elif kept:
            how = {"mode": "part", "buckets": buckets}
        elif rewrite or buckets is not None:
            added, was, how = load.new_target.select(*layout.names), before.count(), {"mode": "full", "buckets": buckets}
        if versioned:
            how["base"] = base
        else:
            how = {"mode": "full" if rewrite else "add"}
        try:
            written = tables.publish(target.schema, target.table, added, tag=f"{own}-load", **how)
        except StaleTable:
            withdraw()
            raise
        if kept_rows is not None:
            result.rows_updated = was - kept_rows.get["rows"]
        result.rows_inserted = written - was
        result.rows_loaded = result.rows_inserted + result.rows_updated
    finally:
        if found is not None:
            found.unpersist()
        if flags is not None:
            system, path = file_system(spark, flags)
            system.delete(path, True)
    return result


def _written(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, str]:
    """The fates of keys as a table of the shared folder, with a partition folder for each, and its path."""
    path = fresh_folder(spark, "flags")
    rows.write.partitionBy(FLAG).parquet(path)
    return spark.read.schema(rows.schema).parquet(path), path


def _reject_table(target: Target) -> tuple[str, str] | None:
    """Schema and name of the table for refused rows."""
    if target.policy not in CAPTURING:
        return None
    logs = target.policy == "IGNORE_AND_LOG"
    schema, _, name = (target.audit_table or DEFAULT_AUDIT_TABLE if logs else target.unprocessed_table).rpartition(".")
    return schema or target.schema, name


_ENTRIES = re.compile(r"(.+-step\d+)-(?:errors|rejects)")


def _drop_entries(store: TableStore, schema: str, table: str, of: Callable[[str], bool]) -> None:
    """Delete errors or refused rows of loads that have not become a version of their target."""
    store.drop_versions([v.path for v in store.versions(schema, table)
                         if v.tag and (m := _ENTRIES.fullmatch(v.tag)) and of(m[1])])


def _keep_rejects(
    step: Step, rejects: DataFrame, layout: T.StructType, tables, migration_id: str, tag: str, at: datetime | None,
) -> int:
    """Write refused rows to the audit or unprocessed table; gives their number."""
    target, columns = step.target, [c.column for c in step.columns]
    if target.policy == "IGNORE_AND_LOG":
        layout = audit_layout(layout, target.keys)
        refused = audit_rows(rejects, columns, migration_id, step.order, target, at)
    else:
        layout = unprocessed_layout(layout)
        refused = unprocessed_rows(rejects, columns, at)
    schema, name = _reject_table(target)
    if tables.exists(schema, name):
        layout = tables.read(schema, name).schema
    return tables.publish(schema, name, fit(refused, layout), mode="add", tag=tag)
