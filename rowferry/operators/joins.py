"""Joins of the sources of one step, and the key match against a target."""

from __future__ import annotations

import functools
import re
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.expressions import expression
from rowferry.spec import Condition, Join

#: Rows of one key that a task may get, and the number of keys that can be spread (see ``salts_of``).
HOT_ROWS = 1_000_000
MOST_HOT = 100_000


def _operand_types(left: DataFrame, right: DataFrame, conditions: Sequence[Condition]):
    """The types of both sides of each condition. Only analysed, never run."""
    both = left.join(right)
    names = both.select(
        *[expression(c.left).alias(f"l{i}") for i, c in enumerate(conditions)],
        *[expression(c.right).alias(f"r{i}") for i, c in enumerate(conditions)]).schema
    kinds = [f.dataType for f in names.fields]
    return list(zip(kinds[:len(conditions)], kinds[len(conditions):]))


def _comparable(value: Column, own: T.DataType, other: T.DataType) -> Column:
    """Text compared with a number is read as a number; text that is none matches nothing."""
    if isinstance(own, T.StringType) and isinstance(other, T.NumericType):
        whole = isinstance(other, T.IntegralType)
        return F.trim(value).try_cast("bigint" if whole else "double")
    return value


def _sides(left: DataFrame, right: DataFrame, conditions: Sequence[Condition]) -> list[tuple[Column, str, Column]]:
    out = []
    for c, (lt, rt) in zip(conditions, _operand_types(left, right, conditions)):
        out.append((_comparable(expression(c.left), lt, rt), c.operator,
                    _comparable(expression(c.right), rt, lt)))
    return out


def _compare(left: Column, operator: str, right: Column) -> Column:
    return {
        "=": lambda: left == right, "!=": lambda: left != right, "<>": lambda: left != right,
        "<": lambda: left < right, "<=": lambda: left <= right,
        ">": lambda: left > right, ">=": lambda: left >= right,
    }[operator]()


def join_source(left: DataFrame, right: DataFrame, join: Join) -> DataFrame:
    """Join one aliased source. Every condition must hold.

    Equalities make it a hash or sort-merge join with the other conditions as its filter; the side
    small enough by its statistics is broadcast by Spark itself. ``salted`` is for a join key that
    holds a large share of the left rows. A range without an equality is joined by dyadic intervals,
    or by stripes of the width ``stripe``.
    """
    if join.stripe:
        at, low, high, bounds = _range_of(join.conditions)
        return range_join(left, right, at, low, high, join.stripe, join.how, **bounds)
    if _is_range(left, right, join.conditions):
        at, low, high, bounds = _range_of(join.conditions)
        return interval_join(left, right, at, low, high, join.how, hot_rows=HOT_ROWS if join.salted else None, **bounds)
    if join.salted:
        return salted_join(left, right, join.source.alias, join.conditions, join.how)
    condition = functools.reduce(
        lambda a, b: a & b, [_compare(*side) for side in _sides(left, right, join.conditions)])
    return left.join(right, condition, join.how.lower())


def join_sources(root: DataFrame, joins: Sequence[Join], frames: Mapping[str, DataFrame]) -> DataFrame:
    """The root joined with each source in listed order; a join may use any earlier alias."""
    for join in joins:
        alias = join.source.alias
        root = join_source(root, frames[alias].alias(alias), join)
    return root


# ---------------------------------------------------------------------------------------------
# Hot keys

def key_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per complete key. Counts combine on the map side, so a hot key costs its tasks one row each."""
    return rows.filter(_all_present(keys)).groupBy(*keys).count()


def salts_of(counts: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(keys, _salts) of the keys with more than ``hot_rows`` rows: among how many tasks each is to be spread,
    by its ``count``. In a table of more than MOST_HOT times as many rows the bound rises with it, so
    no data has more than MOST_HOT such keys and the result can be broadcast."""
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).scalar()
    bound = F.greatest(F.lit(hot_rows).cast("double"), total / MOST_HOT)
    return counts.filter(F.col("count") > bound).select(*keys, F.ceil(F.col("count") / bound).cast("int").alias("_salts"))


def _same(names: Sequence[str], others: Sequence[str]) -> Column:
    return functools.reduce(lambda a, b: a & b, [F.col(n) == F.col(o) for n, o in zip(names, others)])


def _salted_sides(
    left: DataFrame, right: DataFrame, lnames: Sequence[str], rnames: Sequence[str], salts: DataFrame, row: Column,
) -> tuple[DataFrame, DataFrame]:
    """``left`` with ``_salt`` and ``right`` with ``_rsalt``, repeated once per salt of its key. ``salts`` has a
    hot key in the columns _h0, _h1, ..."""
    hot = F.broadcast(salts)
    names = [f"_h{i}" for i in range(len(lnames))]
    # the salt follows from the row and its partition, so a repeated task gives the same one, and
    # equal rows still spread
    spread = F.pmod(F.xxhash64(row, F.spark_partition_id()), F.col("_salts")).cast("int")
    salted = (left.join(hot, _same(lnames, names), "left").withColumn("_salt", F.coalesce(spread, F.lit(0)))
              .drop("_salts", *names))
    every = F.when(F.col("_salts").isNotNull(), F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array(F.lit(0)))
    repeated = (right.join(hot, _same(rnames, names), "left").select("*", F.explode(every).alias("_rsalt"))
                .drop("_salts", *names))
    return salted, repeated


def _hashable(rows: DataFrame) -> Column:
    """A whole row as a value that can be hashed and grouped; maps and variants become text."""
    row = F.struct(rows["*"])  # by their plan, as names may repeat
    return F.to_json(row) if any(kind in rows.schema.simpleString() for kind in ("map<", "variant")) else row


def spread_join(
    left: DataFrame, right: DataFrame, lkeys: Sequence[str], rkeys: Sequence[str], counts: DataFrame, *, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Inner equi-join of named keys whose hot ones, by ``counts`` of left rows per right key, are spread over
    tasks. The right key columns are dropped."""
    hot = salts_of(counts, rkeys, hot_rows).toDF(*[f"_h{i}" for i in range(len(rkeys))], "_salts")
    salted, repeated = _salted_sides(left, right, lkeys, rkeys, hot, _hashable(left))
    on = _same(lkeys, rkeys) & (F.col("_salt") == F.col("_rsalt"))
    return salted.join(repeated, on).drop("_salt", "_rsalt", *rkeys)


def _all_present(keys: Sequence[str]) -> Column:
    return functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def salted_join(
    left: DataFrame,
    right: DataFrame,
    alias: str,
    conditions: Sequence[Condition],
    how: str = "INNER",
    *,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Equi-join whose hot left keys are spread over tasks; same rows as a plain join.

    One count of the left keys says among how many tasks each is spread. Left rows of a hot key get a salt, the right rows of
    those keys are repeated once per salt, and the salt joins the key. Only hot keys repeat. RIGHT and FULL add the right rows none of whose
    copies has a partner in a second step, which is salted as well.
    ``alias`` is the alias of ``right``; it tells which side of an equality is whose.
    """
    sides = _sides(left, right, conditions)
    of_right = re.compile(rf"(?<![\w.]){re.escape(alias)}\s*\.", re.I)
    equal = [(b, a) if of_right.search(c.left) else (a, b)
             for c, (a, op, b) in zip(conditions, sides) if op == "="]
    if not equal:
        raise ValueError("a salted join needs an equality")
    rest = [_compare(*s) for s in sides if s[1] != "="]
    return _keyed_join(left, right, equal, rest, how, hot_rows)


def _keyed_join(
    left: DataFrame, right: DataFrame, equal: Sequence[tuple[Column, Column]], rest: Sequence[Column], how: str, hot_rows: int,
    hint: str | None = None,
) -> DataFrame:
    names, rnames = [f"_k{i}" for i in range(len(equal))], [f"_r_k{i}" for i in range(len(equal))]
    lkeys = left.select("*", *[a.alias(n) for n, (a, _) in zip(names, equal)])
    rkeys = right.select("*", *[b.alias(n) for n, (_, b) in zip(rnames, equal)])
    hot = salts_of(key_counts(lkeys.select(*names), names), names, hot_rows)
    salted, repeated = _salted_sides(lkeys, rkeys, names, rnames, hot.toDF(*[f"_h{i}" for i in range(len(names))], "_salts"), _hashable(left))
    repeated = repeated.hint(hint) if hint else repeated
    condition = functools.reduce(lambda a, b: a & b, [_same(names, rnames), F.col("_salt") == F.col("_rsalt"), *rest])
    helpers = [*names, *rnames, "_salt", "_rsalt"]
    joined = salted.join(repeated, condition, "inner" if how in ("INNER", "RIGHT") else "left").drop(*helpers)
    if how in ("INNER", "LEFT"):
        return joined
    if rest:
        lone = _without_partner(right, salted.join(repeated.select("*", _hashable(right).alias("_key")), condition))
    else:
        present = lkeys.select(*names).filter(_all_present(names)).distinct()
        lone = rkeys.join(present, _same(rnames, names), "left_anti").drop(*rnames)
    return joined.union(_beside_nulls(left, lone))


def _without_partner(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``rows`` that are in none of ``pairs``, joined rows with the row itself (``_hashable``) in ``_key``.

    Rows find each other by themselves, not by a number, which a repeated task might give to another row. Equal
    rows meet the same others, so all of them are alone or none. Those with a partner combine before they are
    shuffled, and the copies that were made for the join stay in its tasks.
    """
    met = pairs.select(F.col("_key").alias("_met")).distinct()
    return (rows.select("*", _hashable(rows).alias("_key")).join(met, F.col("_key") == F.col("_met"), "left_anti")
            .drop("_key"))


def _beside_nulls(left: DataFrame, lone: DataFrame) -> DataFrame:
    return lone.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema.fields], "*")


# ---------------------------------------------------------------------------------------------
# Ranges and keys

_FLIPPED = {">=": "<=", ">": "<", "<=": ">=", "<": ">"}


def _range_of(conditions: Sequence[Condition]) -> tuple[str, str, str, dict[str, bool]]:
    """Point, low and high of two conditions that hold a point between two bounds, and whether the low and
    the high bound itself is in."""
    found = {}
    for at in {c.left for c in conditions} | {c.right for c in conditions}:
        told = [c if c.left == at else Condition(c.right, _FLIPPED[c.operator], c.left)
                for c in conditions if at in (c.left, c.right) and c.operator in _FLIPPED]
        low = [c for c in told if c.operator in (">=", ">")]
        high = [c for c in told if c.operator in ("<=", "<")]
        if len(conditions) == 2 and len(low) == len(high) == 1:
            found[at] = low[0].left, low[0].right, high[0].right, {
                "low_in": low[0].operator == ">=", "high_in": high[0].operator == "<="}
    if len(found) != 1:
        raise ValueError("a range join needs two conditions like 'point >= low' and 'point < high'")
    return next(iter(found.values()))


def _is_range(left: DataFrame, right: DataFrame, conditions: Sequence[Condition]) -> bool:
    """Whether the conditions are a point of the left and a range of the right side, all numbers, or all times."""
    try:
        at, low, high, *_ = _range_of(conditions)
        kinds = [left.select(expression(at)).schema[0].dataType,
                 *(f.dataType for f in right.select(expression(low).alias("l"), expression(high).alias("h")).schema.fields)]
    except (ValueError, AnalysisException):
        return False
    return all(isinstance(k, T.NumericType) for k in kinds) or all(
        isinstance(k, (T.DateType, T.TimestampType, T.TimestampNTZType)) for k in kinds)


def _between(at: Column, lo: Column, hi: Column, low_in: bool, high_in: bool) -> Column:
    return (at >= lo if low_in else at > lo) & (at <= hi if high_in else at < hi)


def range_join(
    left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, how: str = "INNER", *,
    low_in: bool = True, high_in: bool = False,
) -> DataFrame:
    """Left rows with the right rows whose range holds the point, without a nested loop.

    A point falls in one stripe of ``width``; a range is repeated once per stripe it touches, and
    the join is on the stripe. Choose ``width`` near the usual length of a range: a number, days for
    dates, seconds for moments. RIGHT and FULL add the ranges that hold no point, and the empty ones.
    """
    lo, hi, at = expression(low), expression(high), expression(point)
    common = _common_kind(left, right, at, lo, hi)
    stripe = lambda c: F.floor(_place(c, common) / F.lit(width)).cast("bigint")
    points = left.select("*", stripe(at).alias("_stripe"))
    on = (F.col("_stripe") == F.col("_rstripe")) & _between(at, lo, hi, low_in, high_in)
    touched = F.sequence(stripe(lo), stripe(hi))
    if how in ("INNER", "LEFT"):
        ranges = right.filter(lo <= hi).select("*", F.explode(touched).alias("_rstripe"))
        return points.join(ranges, on, how.lower()).drop("_stripe", "_rstripe")
    touched = F.when(lo <= hi, touched).otherwise(F.array(F.lit(None).cast("bigint")))
    ranges = right.select("*", F.explode(touched).alias("_rstripe"))
    joined = points.join(ranges, on, "left" if how == "FULL" else "inner").drop("_stripe", "_rstripe")
    lone = _without_partner(right, points.join(ranges.select("*", _hashable(right).alias("_key")), on))
    return joined.union(_beside_nulls(left, lone))


def _common_kind(left: DataFrame, right: DataFrame, at: Column, lo: Column, hi: Column) -> T.DataType:
    kinds = [left.select(at).schema[0].dataType, *(f.dataType for f in right.select(lo.alias("l"), hi.alias("h")).schema.fields)]
    moments = [k for k in kinds if isinstance(k, (T.TimestampType, T.TimestampNTZType))]
    return moments[0] if moments else kinds[0]


#: Places of dyadic intervals: 0 .. 2^61, the middle for 0; what lies beyond is at the ends.
TOP, MIDDLE = 61, 1 << 60
#: Intervals that are broadcast; with more, both sides are shuffled.
FEW_NODES = 10_000


def interval_join(
    left: DataFrame, right: DataFrame, point: str, low: str, high: str, how: str = "INNER", *,
    low_in: bool = True, high_in: bool = False, hot_rows: int | None = None,
) -> DataFrame:
    """Left rows with the right rows whose range holds the point, for ranges of any length.

    A range from a to b is the union of at most two dyadic intervals of each length 2^k, and a point
    lies in one of each length: a range is repeated for its intervals, at most 2 log2(b - a) of them, a
    point for the lengths that any range has, and the join is an equality on length and number. Exactly one interval of a range holds a point, so no
    pair comes twice. LEFT, RIGHT and FULL add the rows without a partner in any copy.

    Spark's sizes do not know how often rows are repeated, so the intervals are counted: up to FEW_NODES are broadcast,
    else both sides are shuffled. With ``hot_rows`` intervals with more points are spread over tasks.
    """
    lo, hi, at = expression(low), expression(high), expression(point)
    common = _common_kind(left, right, at, lo, hi)
    place = lambda c: _whole_place(c, common)
    first, last = place(lo), place(hi)
    # at length 2^k the rest of the range begins at ceil(first / 2^k) and ends before floor((last + 1) / 2^k);
    # an odd number at either end has no sibling inside, so it is one of the intervals
    ranges = right.select("*", F.when(lo <= hi, first).alias("_first"), F.when(lo <= hi, last + 1).alias("_end"))
    nodes = F.expr("""
        filter(flatten(transform(sequence(0, greatest(0, cast(ceil(log2(_end - _first)) AS int))), k -> array(
          if(shiftrightunsigned(_first + shiftleft(1L, k) - 1, k) % 2 = 1
             AND shiftrightunsigned(_first + shiftleft(1L, k) - 1, k) < shiftrightunsigned(_end, k),
             struct(k AS k, shiftrightunsigned(_first + shiftleft(1L, k) - 1, k) AS n), NULL),
          if(shiftrightunsigned(_end, k) % 2 = 1
             AND shiftrightunsigned(_first + shiftleft(1L, k) - 1, k) < shiftrightunsigned(_end, k),
             struct(k AS k, shiftrightunsigned(_end, k) - 1 AS n), NULL)))), x -> x IS NOT NULL)""")
    none = F.lit(None).cast("struct<k int, n bigint>")
    nodes = F.when(F.col("_first").isNotNull() & F.col("_end").isNotNull(), nodes).otherwise(F.array(none))
    ranges = ranges.select("*", nodes.alias("_nodes"))
    ranges = ranges.select("*", F.explode("_nodes").alias("_node")).select(
        "*", F.col("_node.k").alias("_rk"), F.col("_node.n").alias("_rn")).drop("_first", "_end", "_nodes", "_node")
    # the intervals by their length, at most TOP + 2 numbers
    found = {r["_rk"]: r["count"] for r in ranges.groupBy("_rk").count().collect() if r["_rk"] is not None}
    lengths = sorted(found) or [0]
    hint = "broadcast" if sum(found.values()) <= FEW_NODES else "merge"
    probes = F.array(*[F.struct(F.lit(k).alias("k"), F.call_function("shiftrightunsigned", F.col("_at"), F.lit(k)).alias("n"))
                       for k in lengths])
    points = (left.select("*", place(at).alias("_at")).select("*", F.explode(probes).alias("_node"))
              .select("*", F.col("_node.k").alias("_lk"), F.col("_node.n").alias("_ln")).drop("_at", "_node"))
    inside = _between(at, lo, hi, low_in, high_in)
    equal = [(F.col("_lk"), F.col("_rk")), (F.col("_ln"), F.col("_rn"))]
    on = (F.col("_lk") == F.col("_rk")) & (F.col("_ln") == F.col("_rn")) & inside

    def pairs(points: DataFrame, ranges: DataFrame) -> DataFrame:
        if hot_rows:
            both = _keyed_join(points, ranges, equal, [inside], "INNER", hot_rows, hint)
        else:
            both = points.join(ranges.hint(hint), on)
        return both.drop("_lk", "_ln", "_rk", "_rn")

    joined = pairs(points, ranges)
    if how in ("LEFT", "FULL"):
        lone = _without_partner(left, pairs(points.select("*", _hashable(left).alias("_key")), ranges))
        joined = joined.union(lone.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields]))
    if how in ("RIGHT", "FULL"):
        lone = _without_partner(right, pairs(points, ranges.select("*", _hashable(right).alias("_key"))))
        joined = joined.union(_beside_nulls(left, lone))
    return joined


def _whole_place(value: Column, kind: T.DataType) -> Column:
    """A whole number from 0 to 2^61 that does not fall when the value rises."""
    number = F.unix_micros(value.cast(kind)) if isinstance(kind, T.TimestampType) else _place(value, kind)
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        limit, number = F.lit(float(MIDDLE)), number.cast("double")
        number = F.when(F.isnan(number), limit).otherwise(F.floor(F.greatest(F.least(number, limit), -limit)))
    whole = F.greatest(F.least(number.cast("bigint"), F.lit(MIDDLE - 1)), F.lit(1 - MIDDLE))
    return whole + F.lit(MIDDLE)


def _place(value: Column, kind: T.DataType) -> Column:
    """A number that rises with the value: itself, the days of a date, the seconds of a moment."""
    if isinstance(kind, T.DateType):
        return F.unix_date(value)
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(value.cast(kind))
    if isinstance(kind, T.TimestampNTZType):  # without a zone, so that no hour comes twice
        at = value.cast(kind)
        days = F.unix_date(at.cast("date")).cast("bigint")
        return days * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    return value


def rows_with_key_in(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key also occurs in ``other``; a NULL in a key matches nothing."""
    return rows.join(other.select(*keys), list(keys), "left_semi")
