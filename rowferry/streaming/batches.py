"""Bounded batches: a folder read as a stream, staged batch by batch, then loaded once."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.operators import ledger as ledgers
from rowferry.operators.shape import evaluate
from rowferry.plans.blueprint import CAPTURING, StepResult, load_step, transformed
from rowferry.sinks.tables import TableStore
from rowferry.spec import Step
from rowferry.workspace import file_system

#: A folder of plain Parquet, partitioned by stream and run: a batch adds one file and lists nothing.
METRICS = ("migration_admin", "stream_batches")
METRICS_LAYOUT = f"{ledgers.METRICS_SCHEMA}, noted_at timestamp, stream string, run string"


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, *, fmt: str = "parquet",
    files_per_batch: int | None = None, bytes_per_batch: str | None = None, **options: str,
) -> DataFrame:
    """Files as a stream whose batches are bounded by file count or bytes."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.load(path)


def stage_row_batches(df: DataFrame, folder: str, batch_size: int, key: str | None = None) -> None:
    """Rows of a table as files of at most ``batch_size`` rows under ``folder``, for ``row_stream``.

    Files hold neighbouring keys, in order, so a batch touches a narrow range of the target. Range partitions
    have about ``batch_size`` rows; one that a dense key makes larger is cut into several files by its writer. Called again
    with later rows, it adds files.
    """
    if batch_size < 1:
        raise ValueError("a batch has at least one row")
    rows = df
    if key is not None:
        parts = max(1, -(-df.count() // batch_size))
        rows = df.repartitionByRange(parts, key).sortWithinPartitions(key)
    rows.write.mode("append").option("maxRecordsPerFile", batch_size).parquet(folder)


def row_stream(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """What ``stage_row_batches`` wrote, as a stream of one file per batch: no batch has more rows than a
    file, and a run that is restarted from its checkpoint goes on behind the last file it finished."""
    return file_stream(spark, folder, schema, files_per_batch=1)


def stage_stream(
    stream: DataFrame, step: Step, store: TableStore, name: str, checkpoint: str, *,
    frames: dict[str, DataFrame] | None = None, on_batch: Callable[[int, int, float], None] | None = None,
    **checks,
) -> str:
    """Take everything the stream has, batch by batch, into the staged table ``name``.

    The root of the step is the stream; ``frames`` are its joined sources. Spark may hand a batch
    over twice after a failure; a batch is staged under the number it has in its checkpoint, so the
    second time writes nothing. Gives the identity of the checkpoint.
    """
    spark = stream.sparkSession
    checks.setdefault("key_text", step.target.policy in CAPTURING)

    def take(batch: DataFrame, number: int) -> None:
        began = time.monotonic()
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        tag = f"{run}-b{number}"
        rows = transformed(step, {**(frames or {}), step.root.alias: batch})
        rows = evaluate(rows, step.columns, step.target.keys,
                        also=[F.lit(number).cast("bigint").alias("_batch")], **checks)
        written = store.publish("staging", name, rows, mode="add", tag=tag)
        took = (time.monotonic() - began) * 1000
        (ledgers.batch_metrics(spark, step.order, number, written, took)
         .select("*", F.current_timestamp().alias("noted_at"), F.lit(name).alias("stream"), F.lit(run).alias("run"))
         .write.mode("append").partitionBy("stream", "run").parquet(store.folder(*METRICS)))
        if on_batch:
            on_batch(number, written, took)

    query = (stream.writeStream.foreachBatch(take).trigger(availableNow=True)
             .option("checkpointLocation", checkpoint).start())
    query.awaitTermination()
    return str(query.id)


def stream_metrics(spark: SparkSession, store: TableStore, name: str) -> DataFrame:
    """(blueprint_sequence, batch_number, rows_processed, duration_ms) of a staged stream; of a batch that Spark
    handed over twice, the first entry."""
    names = [f.split()[0] for f in ledgers.METRICS_SCHEMA.split(", ")]
    system, folder = file_system(spark, store.folder(*METRICS))
    if not system.exists(folder):
        return ledgers.empty(spark, ledgers.METRICS_SCHEMA)
    noted = spark.read.schema(METRICS_LAYOUT).parquet(store.folder(*METRICS)).where(F.col("stream") == name)
    first = F.min_by(F.struct(*names), F.struct("noted_at", "duration_ms")).alias("first")
    return noted.groupBy("run", F.col("batch_number").alias("number")).agg(first).select("first.*")


def run_stream(
    spark: SparkSession, stream: DataFrame, step: Step, store: TableStore, name: str, checkpoint: str, *,
    frames: dict[str, DataFrame] | None = None, **load_options,
) -> StepResult:
    """Stage what is new, then load those batches under the step's policy in one go.

    Where batches share a key, a later batch counts as later. The load is tagged with the last batch
    it holds: the next run loads the batches after that one, and a load that is repeated after a
    failure is not applied twice. Staged batches are deleted once they are loaded.
    """
    query = stage_stream(stream, step, store, name, checkpoint, frames=frames)
    target, mark = step.target, f"{name}-{query}-upto"
    upto = lambda tag: int(tag.removeprefix(mark).split("-")[0]) if tag.startswith(mark) else -1
    loaded = max((upto(v.tag) for v in store.versions(target.schema, target.table) if v.tag), default=-1)
    staged = {int(v.tag.removeprefix(f"{query}-b")): v.path for v in store.versions("staging", name)
              if v.tag and v.tag.startswith(f"{query}-b")}
    new = sorted(n for n in staged if n > loaded)
    if not new:
        return StepResult(step.order, skipped=True)
    rows = store.read("staging", name, [staged[n] for n in new])
    # errors and refused rows of a load that died are in this one again, whose last batch may be a later one
    result = load_step(spark, step, rows, store, tag=f"{mark}{new[-1]}", order_by=["_batch", *target.order_by],
                       superseded=lambda tag: upto(tag) > loaded, **load_options)
    store.drop_versions(list(staged.values()))
    return result
