"""Loading a batch into a keyed target.

Each policy is a function of (target, batch, keys) and gives a ``Load``: lazy frames that say what
the target becomes and which rows are refused. Nothing is written here.

Several batch rows may share a key. UPSERT keeps the greatest by ``order_by``, IGNORE the least;
all batch columns break ties, so a rerun gives the same target. The pick is an aggregate, not a
window: each map task sends one row per key, however many rows the key has.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.operators.joins import HOT_ROWS, key_counts, rows_with_key_in, spread_join

DUPLICATE_KEY = "DUPLICATE_KEY"
#: The column that tells which batch or chunk of a load a row came in.
BATCH = "_batch"
DUPLICATE_IN_BATCH = "DUPLICATE_IN_BATCH"
NULL_KEY = "NULL_KEY"
#: The column with the fate of a key, and its values.
FLAG = "flag"
MET, SEVERAL, NEW = "met", "several", "new"


class KeyConflict(Exception):
    """A FAIL load met duplicate or missing keys; nothing was loaded."""


@dataclass(frozen=True)
class Load:
    """What one load does.

    ``append``     rows to add to the target unchanged
    ``new_target`` the whole target afterwards
    ``rewrites``   True when existing rows change, so that ``append`` alone is not enough
    ``rejects``    refused rows with ``reject_reason``
    ``conflicts``  for FAIL: the keys that forbid the load; it may go on only if this is empty
    """

    append: DataFrame
    new_target: DataFrame
    rewrites: bool
    rejects: DataFrame
    conflicts: DataFrame | None = None


def _every(tests: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, tests)


def has_key(keys: Sequence[str]) -> Column:
    return _every([F.col(k).isNotNull() for k in keys]) if keys else F.lit(True)


def one_per_key(
    rows: DataFrame, keys: Sequence[str], order_by: Sequence[str] = (), *, greatest: bool = True,
) -> DataFrame:
    """The greatest (or least) row of each key by ``order_by``, then by all columns."""
    rest = [c for c in rows.columns if c not in keys]
    first = [c for c in order_by if c in rest]
    ranked = [*first, *[c for c in rest if c not in first]]
    if not ranked:
        return rows.select(*keys).distinct().select(*rows.columns)
    pick = (F.max if greatest else F.min)(F.struct(*ranked)).alias("_row")
    return rows.groupBy(*keys).agg(pick).select(*[
        F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def keys_compared_as(collation: str, keys: Sequence[str], *frames: DataFrame) -> tuple[list[str], list[DataFrame]]:
    """The frames with their keys once more, text compared under ``collation``, and the names of these columns.

    A policy that is given these names finds 'Ab' and 'aB' one key under UTF8_LCASE, while the keys themselves are
    columns like others, so that every row keeps its spelling and ties are broken by it.
    """
    names = [f"_like_{k}" for k in keys]

    def like(frame: DataFrame, key: str) -> Column:
        return F.collate(F.col(key), collation) if isinstance(frame.schema[key].dataType, T.StringType) else F.col(key)

    return names, [f.withColumns({n: like(f, k) for n, k in zip(names, keys)}) for f in frames]


def _add(target: DataFrame, rows: DataFrame) -> DataFrame:
    return target.unionByName(rows.select(*[c for c in target.columns if c in rows.columns]),
                              allowMissingColumns=True).select(*target.columns)


def _null_key_rows(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    return batch.filter(~has_key(keys)).withColumn("reject_reason", F.lit(NULL_KEY))


#: Keys of a batch that are broadcast to a scan of the target; with more, both sides are shuffled.
FEW_KEYS = 100_000


def match_hint(batch_rows: int) -> str:
    """How the keys of a batch of that many rows are joined with a target. Spark's own sizes come from files: after a
    narrow column of a packed or wide file is picked, millions of keys seem small enough for the driver."""
    return "broadcast" if batch_rows <= FEW_KEYS else "merge"


def rows_and_span(batch: DataFrame, keys: Sequence[str]) -> tuple[int, dict[str, tuple] | None]:
    """The batch's number of rows, and the least and greatest value of each key column that is a whole number or a
    decimal; None if such a column has no value, so that no key can be met. Only these: their values come to the
    driver and go back into filters as they are."""
    kinds = {k: batch.schema[k].dataType for k in keys}
    spanned = [k for k in keys if isinstance(kinds[k], (T.IntegralType, T.DecimalType))]
    one = batch.agg(F.count(F.lit(1)).alias("rows"), *[end(k).alias(f"{i}{j}") for i, k in enumerate(spanned)
                                                       for j, end in enumerate((F.min, F.max))]).first()
    span = {k: (one[f"{i}0"], one[f"{i}1"]) for i, k in enumerate(spanned)}
    return one["rows"], None if any(lo is None for lo, _ in span.values()) else span


def parted(target: DataFrame, span: dict[str, tuple] | None) -> tuple[DataFrame, DataFrame | None]:
    """The target's rows whose keys are within a batch's span, and the others, which the batch leaves as they are; a
    NULL key is among the others. Both filters reach the target's scan, so that it passes over files and row groups.
    """
    if span is None:
        return target.limit(0), target
    if not span:
        return target, None
    ends = [(F.col(k), *[F.lit(end).cast(target.schema[k].dataType) for end in span[k]]) for k in span]
    outside = functools.reduce(lambda a, b: a | b, [(k < lo) | (k > hi) | k.isNull() for k, lo, hi in ends])
    return target.filter(_every([(k >= lo) & (k <= hi) for k, lo, hi in ends])), target.filter(outside)


def meets_some(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> bool:
    """True if one of some FEW_KEYS keys of the batch is in the target, which a scan of the target tells, at most.
    False tells nothing."""
    some = batch.select(*keys).filter(has_key(keys)).limit(FEW_KEYS)
    return not rows_with_key_in(target.select(*keys), some.hint("broadcast"), list(keys)).isEmpty()


def met_keys(target: DataFrame, batch: DataFrame, keys: Sequence[str], hint: str | None = None) -> DataFrame:
    """The target's keys that the batch also has.

    The target is the streamed side: with a small batch its keys are broadcast and the target is
    only scanned, with a large one both sides shuffle their key columns. What is left is no larger
    than the batch, so later joins with it do not touch the target again. ``hint`` is ``match_hint``'s,
    without it Spark's sizes decide.
    """
    keys = list(keys)
    # the counts are those that ``hot_keys`` needs; asking for them here lets both share one shuffle
    ours = key_counts(batch, keys).filter("count > 0")
    return rows_with_key_in(target.select(*keys), ours.hint(hint) if hint else ours, keys)


def key_flags(target: DataFrame, batch: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """The fate of every key of a batch, from one scan of the batch and one of the target's keys.

    Both are one tagged union with one aggregate per key, which combines before its shuffle: FLAG is
    MET (the target has the key), SEVERAL (new, with several batch rows) or NEW. Besides, the row that IGNORE picks, the rows of the key
    and the batch it first came in.
    """
    keys = list(keys)
    rest = [c for c in batch.columns if c not in keys]
    first = [c for c in order_by if c in rest]
    row = F.struct(*[*first, *[c for c in rest if c not in first]]) if rest else F.struct(F.lit(0).alias("_none"))
    number = F.col(BATCH) if BATCH in batch.columns else F.lit(0).cast("bigint")
    ours = batch.filter(has_key(keys)).select(*keys, row.alias("_row"), number.alias("_number"), F.lit(0).alias("_there"))
    theirs = target.select(*keys, F.lit(None).cast(ours.schema["_row"].dataType).alias("_row"),
                           F.lit(None).cast("bigint").alias("_number"), F.lit(1).alias("_there"))
    each = ours.unionByName(theirs).groupBy(*keys).agg(
        F.max("_there").alias("_there"), F.min("_row").alias("_row"), F.count("_row").alias("_rows"), F.min("_number").alias("_first"))
    flag = F.when(F.col("_there") == 1, MET).when(F.col("_rows") > 1, SEVERAL).otherwise(NEW)
    return each.filter("_rows > 0").select(*keys, "_row", "_rows", "_first", flag.alias(FLAG))


def flagged(batch: DataFrame, keys: Sequence[str], flags: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The batch rows whose key was met or came several times, with the flag, winner and first batch of
    the key: one scan and one join, in which rows of hot keys are spread by the number of their rows."""
    wanted = flags.filter(F.col(FLAG) != NEW).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                                                     F.col("_row").alias("_winner"), "_rows", "_first", FLAG)
    return spread_join(batch.filter(has_key(keys)), wanted, keys, [f"_k{i}" for i in range(len(keys))],
                       wanted.select(*[f"_k{i}" for i in range(len(keys))], F.col("_rows").alias("count")), hot_rows=hot_rows)


def captured(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, flags: DataFrame | None = None,
) -> DataFrame:
    """All batch rows whose key is in the target before the load."""
    flags = flags if flags is not None else key_flags(target, batch, keys)
    return (flagged(batch, list(keys), flags, hot_rows).filter(F.col(FLAG) == MET).select(*batch.columns)
            .withColumn("reject_reason", F.lit(DUPLICATE_KEY)))


def fail(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], order_by: Sequence[str] = (),
    met: DataFrame | None = None,
) -> Load:
    """Plain insert; any key that repeats, is in the target, or is NULL forbids it.

    The keys of batch and target (or ``met``) are one tagged union with one aggregate, which combines before its shuffle:
    no join, whose sides a task would sort besides.
    """
    keys = list(keys)
    append = batch
    if not keys:
        return Load(append, _add(target, append), False, _no_rejects(batch), None)
    ours = batch.select(*keys, F.lit(1).cast("bigint").alias("_ours"))
    theirs = (met if met is not None else target).filter(has_key(keys)).select(*keys, F.lit(0).cast("bigint").alias("_ours"))
    # rows of the batch have 1, those of the target 0
    counts = ours.unionByName(theirs).groupBy(*keys).agg(
        F.sum("_ours").alias("batch_rows"), (F.min("_ours") == 0).alias("in_target")).filter("batch_rows > 0")
    reason = (F.when(~has_key(keys), NULL_KEY).when(F.col("in_target"), DUPLICATE_KEY)
              .when(F.col("batch_rows") > 1, DUPLICATE_IN_BATCH))
    conflicts = counts.withColumn("reject_reason", reason).filter("reject_reason is not null")
    return Load(append, _add(target, append), False, _no_rejects(batch), conflicts)


def _no_rejects(batch: DataFrame) -> DataFrame:
    return batch.filter(F.lit(False)).withColumn("reject_reason", F.lit(None).cast("string"))


def ignore(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], order_by: Sequence[str] = (),
    met: DataFrame | None = None,
) -> Load:
    """Insert rows whose key is new."""
    keys = list(keys)
    if not keys:
        return Load(batch, _add(target, batch), False, _no_rejects(batch))
    rows = one_per_key(batch.filter(has_key(keys)), keys, order_by, greatest=False)
    there = met if met is not None else met_keys(target, batch, keys)
    append = rows.join(there, keys, "left_anti").select(*batch.columns)
    return Load(append, _add(target, append), False, _null_key_rows(batch, keys))


def replaces_rows(target: DataFrame, batch: DataFrame, stays: Sequence[str] = ()) -> bool:
    """Whether an UPSERT takes whole rows of the batch, and keeps no column of those it meets."""
    return not stays and set(target.columns) <= set(batch.columns)


def upsert(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], order_by: Sequence[str] = (),
    met: DataFrame | None = None, *, stays: Sequence[str] = (), apart: DataFrame | None = None,
    kept_rows: Observation | None = None, hint: str | None = None,
) -> Load:
    """Insert new keys, replace the mapped non-key columns of existing ones.

    Target columns that the batch does not have keep their value. When the batch has all of them,
    the kept target rows are found by an anti join, which only scans the target if the keys to
    replace are few; otherwise old and new rows meet in one full join of unique keys. ``stays`` are columns
    that an existing row keeps as well, such as the spelling of a key that is compared without case.
    ``apart`` are rows of the target beside ``target`` that the batch cannot meet. Without ``met`` the anti join is with the
    batch's keys, under ``hint``. ``kept_rows`` observes the ``rows`` of the target that stay, if the batch has all columns.
    """
    keys = _needed(keys, "UPSERT")
    both = lambda rows: rows if apart is None else apart.select(*target.columns).unionByName(rows)
    rows = one_per_key(batch.filter(has_key(keys)), keys, order_by, greatest=True)
    rejects = _null_key_rows(batch, keys)
    mapped = [c for c in target.columns if c in rows.columns]
    if replaces_rows(target, batch, stays):
        there = met if met is not None else rows.select(*keys)
        there = there.hint(hint) if met is None and hint else there
        kept = both(target.join(there, keys, "left_anti").select(*target.columns))
        if kept_rows is not None:
            kept = kept.observe(kept_rows, F.count(F.lit(1)).alias("rows"))
        return Load(rows, _add(kept, rows), True, rejects)
    new = rows.select(*[F.col(c).alias(f"_n_{c}") for c in mapped], F.lit(True).alias("_new"))
    on = _every([F.col(k) == F.col(f"_n_{k}") for k in keys])
    old = _every([F.col(k).isNotNull() for k in keys])

    def value(c: str) -> Column:
        taken = F.col("_new") & ~old if c in stays else F.col("_new")
        return F.when(taken, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)

    merged = target.join(new, on, "full").select(
        *[value(c) if c in mapped else F.col(c) for c in target.columns])
    return Load(rows, both(merged), True, rejects)


def ignore_and_capture(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], order_by: Sequence[str] = (),
    met: DataFrame | None = None, *, log_batch_duplicates: bool = False, hot_rows: int = HOT_ROWS,
    carried: Sequence[str] = (), flags: DataFrame | None = None,
) -> Load:
    """IGNORE, with the rows that met an existing key as rejects (for a log or unprocessed table).

    Where batches are loaded in order, rows whose key came in an earlier batch and was new then are
    rejects too: loaded one after the other, they would have met it. ``log_batch_duplicates`` adds
    the rows that lose to another one of their batch, one for equal copies with their number in ``copies``.
    ``carried`` columns of the batch go with the rejects only. ``flags`` are ``key_flags`` of the batch without them.
    """
    keys = _needed(keys, "a policy that captures conflicts")
    plain = batch.drop(*carried)
    flags = flags if flags is not None else key_flags(target, plain, keys, order_by)
    rest = [c for c in plain.columns if c not in keys]
    append = flags.filter(F.col(FLAG) != MET).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in plain.columns])
    found = flagged(batch, keys, flags, hot_rows)
    refused = F.col(FLAG) == MET
    if order_by and order_by[0] == BATCH:
        refused = refused | (F.col(BATCH) > F.col("_first"))
    rejects = (found.filter(refused).select(*batch.columns).withColumn("reject_reason", F.lit(DUPLICATE_KEY))
               .unionByName(_null_key_rows(batch, keys)))
    if log_batch_duplicates:
        own = F.struct(*[F.col(f"_winner.{c}") for c in rest]) if rest else F.lit(None)
        losers = found.filter(~refused).select(*plain.columns, _same_row(rest, own).alias("_won"))
        # the winner of a key loses one copy
        lost = losers.groupBy(*plain.columns).agg((F.count(F.lit(1)) - F.max(F.col("_won").cast("int"))).alias("copies"))
        rejects = rejects.withColumn("copies", F.lit(1).cast("bigint")).unionByName(
            lost.filter("copies > 0").withColumn("reject_reason", F.lit(DUPLICATE_IN_BATCH)), allowMissingColumns=True)
    return Load(append, _add(target, append), False, rejects)


def _same_row(columns: Sequence[str], winner: Column) -> Column:
    """Whether a row's columns are those of the winner of its key."""
    return F.struct(*columns).eqNullSafe(winner) if columns else F.lit(True)


def _needed(keys: Sequence[str], what: str) -> list[str]:
    if not keys:
        raise ValueError(f"{what} needs primary key columns")
    return list(keys)


POLICIES: dict[str, Callable[..., Load]] = {
    "FAIL": fail,
    "IGNORE": ignore,
    "UPSERT": upsert,
    "IGNORE_AND_LOG": ignore_and_capture,
    "IGNORE_AND_INSERT_UNPROCESSED": ignore_and_capture,
}


def require_no_conflicts(load: Load) -> None:
    """Raise KeyConflict when a FAIL load may not go on. Fetches one key at most."""
    if load.conflicts is None:
        return
    found = load.conflicts.limit(1).collect()
    if found:
        raise KeyConflict(f"{found[0]['reject_reason']}: {found[0].asDict()}")


def append_sources(
    frames: Sequence[DataFrame], keys: Sequence[str], order_by: Sequence[str] = (),
) -> DataFrame:
    """Several sources of one target as if upserted in turn: a later source wins a shared key.

    One union and one aggregate in place of one target rewrite per source.
    """
    numbered = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    every = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    rows = one_per_key(every.filter(has_key(keys)), list(keys), ["_source", *order_by])
    return rows.drop("_source")
