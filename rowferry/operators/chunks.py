"""Key ranges of a chunked load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(key: Column) -> Column:
    """The least whole number that is not below a key of any type; NULL for text that is no number.
    A range ``(lo, hi]`` of whole numbers holds a key exactly if it holds this."""
    return F.ceil(key.try_cast("decimal(38,9)")).try_cast("bigint")


def chunk_bounds(df: DataFrame, key: str, lower: int | None = None) -> DataFrame:
    """One row (lo, hi). Ranges are ``(lo, lo + size]``; without ``lower`` they start below the
    least key so that no row is left out; ``lower=0`` leaves out keys of 0 and less."""
    k = whole(F.col(key))
    low = F.coalesce(F.min(k) - 1, F.lit(0)) if lower is None else F.lit(lower)
    return df.agg(low.cast("bigint").alias("lo"), F.coalesce(F.max(k), F.lit(0)).alias("hi"))


def chunk_filter(df: DataFrame, key: str, lo: int, size: int) -> DataFrame:
    """The rows of one range, ``lo < key <= lo + size``; reaches the scan as a pushed filter."""
    k = F.col(key)
    return df.filter((k > lo) & (k <= lo + size))


def chunk_number(key: Column, lo: Column | int, size: int) -> Column:
    """1 for ``(lo, lo + size]``, 2 for the next range; 0 for a NULL key and text that is no number."""
    start = (lo if isinstance(lo, Column) else F.lit(lo)).cast("bigint")
    above, width = whole(key) - start - 1, F.lit(size).cast("bigint")
    number = F.call_function("div", above - F.pmod(above, width), width) + 1
    return F.coalesce(number, F.lit(0).cast("bigint"))


def with_chunk(df: DataFrame, key: str, size: int, lower: int | None = None) -> DataFrame:
    """``df`` with its ``chunk`` number; the lower bound is a scalar subquery, not a join."""
    if lower is None:
        lo = chunk_bounds(df, key).select("lo").scalar()
        return df.withColumn("chunk", chunk_number(F.col(key), lo, size))
    return df.filter(F.col(key) > lower).withColumn("chunk", chunk_number(F.col(key), lower, size))


def chunk_plan(df: DataFrame, key: str, size: int, lower: int | None = None) -> DataFrame:
    """One row per non-empty chunk: its number, least and greatest key, and row count."""
    return (with_chunk(df, key, size, lower)
            .groupBy("chunk")
            .agg(F.min(key).cast("bigint").alias("min_key"), F.max(key).cast("bigint").alias("max_key"),
                 F.count(F.lit(1)).alias("rows")))


def load_ranges(lo: int, hi: int, size: int, commits: int, ends: Sequence[int] = ()) -> list[tuple[int, int]]:
    """The ranges ``(lo, hi]`` of a load in at most ``commits`` parts, each of whole chunks: of equal width,
    or up to the chunks that ``ends`` fall in."""
    if not ends:
        step = size * max(1, -(-(-(-(hi - lo) // size)) // commits))
        ends = range(lo + step, hi, step)
    cuts = sorted({lo - (lo - end) // size * size for end in ends})
    cuts = [lo, *[c for c in cuts if lo < c < hi], *([hi] if hi > lo else [])]
    return list(zip(cuts, cuts[1:]))


def even_ends(df: DataFrame, key: str, parts: int) -> list[int]:
    """Keys that cut the rows into about equal parts, from one quantile sketch over all rows; the driver gets
    one number per part. Dense regions get narrow ranges."""
    shares = [i / parts for i in range(1, parts)]
    if not shares:
        return []
    found = df.agg(F.percentile_approx(whole(F.col(key)), shares, 10_000).alias("ends")).first()["ends"]
    return sorted(set(found or []))


def part_number(key: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    """1, 2, ... for the range a key is in, the last one being open above; 0 for keys below the first and those
    that are no number."""
    at = whole(key)
    inner = F.array(*[F.lit(hi).cast("bigint") for _, hi in ranges[:-1]]).cast("array<bigint>")
    number = F.size(F.filter(inner, lambda end: end < at)) + 1
    return F.when(at > ranges[0][0], number).otherwise(0)


def fingerprints(root: DataFrame, key: str, ranges: Sequence[tuple[int, int]], watch: Sequence[str] = ()) -> dict[int, str]:
    """Rows and an order-free checksum of the keys, and of the ``watch`` columns, in each range: one aggregate
    that combines before its shuffle. A range whose text is the same as before has the same keys."""
    values = [F.col(key), *[F.col(c) for c in watch]]
    # NULLs are hashed by a flag, as the hash passes over them
    one = F.xxhash64(*[x for v in values for x in (v.isNull(), v)]).cast("decimal(38,0)")
    found = (root.select(part_number(F.col(key), ranges).alias("part"), one.alias("h")).groupBy("part")
             .agg(F.count(F.lit(1)).alias("rows"), F.sum("h").alias("sum")))
    return {r["part"]: f"{r['rows']}-{int(r['sum']) % (1 << 64):016x}" for r in found.collect()}
