"""Helpers that several operators share: column shorthands, written tables, running sums."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rowferry.workspace import file_system, fresh_folder

#: Characters between words, for Spark's split (a word is a run of any others).
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column, between: str = SPACES) -> Column:
    """The words of a text as an array; NULL has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), between), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def indexes(count: Column) -> Column:
    """0 .. count-1 as an array; empty for a count of 0 or less."""
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(
        F.array().cast("array<int>"))


def written(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: its lineage ends there."""
    spark = df.sparkSession
    path = fresh_folder(spark, purpose)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a ``written`` table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {path.rsplit("/", 1)[0] for path in df.inputFiles()}:
        system, path = file_system(spark, folder)
        system.delete(path, True)


def running_sum(df: DataFrame, group: str, value: str, order: Sequence[str], name: str, rows: int,
                rows_per_chunk: int = 4_000) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows before a row, within its group.

    Equal rows are counted first, so however often one repeats it is one row of the windows; its
    copies are dealt out afterwards, those of a frequent row by many tasks. A group may hold a third
    of all rows, so it is cut into chunks by a hash of ``order``. Sums inside a chunk are a window over
    some ``rows_per_chunk`` rows; chunks are then put one after the other by a window over one row per
    chunk. ``rows`` is the number of rows of ``df``, ``group`` has no NULL, and ``order`` tells all
    different rows of a group apart.
    """
    chunks = max(1, -(-rows // rows_per_chunk))
    sums = F.col(value) * F.col("_copies")
    inside = Window.partitionBy(group, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    distinct = (df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
                .withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks))))
    starts = (distinct.groupBy(group, "_chunk").agg(F.sum(sums).alias("_sum"))
              .select(group, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start")))
    summed = (distinct.withColumn("_inside", F.coalesce(F.sum(sums).over(inside), F.lit(0)))
              .join(starts, [group, "_chunk"]).withColumn("_first", F.col("_start") + F.col("_inside")))
    few = summed.where(F.col("_copies") <= rows_per_chunk).withColumn("_from", F.lit(0).cast("long"))
    many = (summed.where(F.col("_copies") > rows_per_chunk)
            .withColumn("_from", F.explode(F.expr(f"sequence(0L, _copies - 1, {rows_per_chunk}L)")))
            .repartition(*order, "_from"))
    last = F.least(F.col("_copies"), F.col("_from") + rows_per_chunk) - 1
    return (few.unionByName(many).withColumn("_copy", F.explode(F.sequence(F.col("_from"), last)))
            .select(*df.columns, (F.col("_first") + F.col("_copy") * F.col(value)).alias(name)))
