"""Filters, derived variables and the projection onto mapped target columns."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.casts import as_text, cast_failed, fitted, parse_type, safe_cast, type_name
from rowferry.functions.expressions import expression
from rowferry.spec import ColumnMap

ERRORS = "_errors"
IDENTITY = "_identity"
KEY_TEXT = "_key_text"
#: The column of a source that holds the text of records with another number of cells than the header.
MALFORMED = "_malformed"
_PATH = re.compile(r"[\w$ ]+(\.[\w$ ]+)*")


def keep_rows(df: DataFrame, predicates: Iterable[str]) -> DataFrame:
    """Rows that pass every predicate; used on the root (pre) and after derivations (post)."""
    for predicate in predicates:
        df = df.filter(expression(predicate))
    return df


def derive(df: DataFrame, derivations: Mapping[str, str]) -> DataFrame:
    """Add named expressions beside all source columns.

    Each is reachable by its bare name and as ``derivations.<name>``; none may use another one.
    """
    if not derivations:
        return df
    # inside a struct no value can see another; beside it, each gets its bare name too
    values = [expression(text).alias(name) for name, text in derivations.items()]
    df = df.select("*", F.struct(*values).alias("derivations"))
    return df.select("*", *[F.col("derivations")[name].alias(name) for name in derivations])


def mapped_value(column: ColumnMap) -> Column:
    """The value of a mapping before its cast."""
    if column.kind in ("DIRECT", "DERIVED") and _PATH.fullmatch(column.value.strip()):
        return F.col(column.value.strip())
    return expression(column.value)


def _raw(df: DataFrame, columns: Sequence[ColumnMap], also: Sequence[Column] = ()):
    """Uncast values as ``_0, _1, ...`` and their types."""
    raw = df.select(*[mapped_value(c).alias(f"_{i}") for i, c in enumerate(columns)], *also)
    return raw, [field.dataType for field in raw.schema.fields[:len(columns)]]


def project(df: DataFrame, columns: Sequence[ColumnMap]) -> DataFrame:
    """Exactly the mapped columns, in mapping order, safely cast and renamed."""
    raw, types = _raw(df, columns)
    return raw.select(*[
        safe_cast(F.col(f"_{i}"), c.cast_to, t).alias(c.column)
        for i, (c, t) in enumerate(zip(columns, types))
    ])


def evaluate(
    df: DataFrame,
    columns: Sequence[ColumnMap],
    keys: Sequence[str] = (),
    *,
    check_length: bool = False,
    check_null: bool = False,
    key_text: bool = False,
    malformed: str | None = None,
    also: Sequence[Column] = (),
) -> DataFrame:
    """``project`` plus what went wrong per row, from the same pass.

    ``_errors`` lists (target_column, error_code, message, raw_value) and is NULL for a good row.
    ``_identity`` maps the key columns to their uncast text, so that a row with a bad key can still
    be found; it is filled for rows with an error or without a key. ``key_text`` adds that text of
    all rows as the struct ``_key_text``. ``malformed`` names the column that holds the text of
    records with too few or too many cells.
    """
    records = [F.col(malformed).alias(MALFORMED)] if malformed else []
    raw, types = _raw(df, columns, [*also, *records])
    cast = raw.select("*", *[
        safe_cast(F.col(f"_{i}"), c.cast_to, t).alias(f"_c{i}")
        for i, (c, t) in enumerate(zip(columns, types))
    ])
    found, identity, named, no_key = [], [], [], []
    for i, (c, t) in enumerate(zip(columns, types)):
        value, result = F.col(f"_{i}"), F.col(f"_c{i}")
        text = as_text(value, t)
        base, args = parse_type(c.cast_to)
        failed = cast_failed(value, result, t)
        found.append((failed, c.column, "CAST_FAILED", f"Invalid {base}", text))
        if check_length and base in ("VARCHAR", "CHAR") and args:
            found.append((F.coalesce(F.length(result) > args[0], F.lit(False)), c.column, "TOO_LONG",
                          f"Longer than {args[0]} characters", text))
        if check_null and not c.nullable:
            found.append((result.isNull() & ~failed, c.column, "NULL_VALUE",
                          "No value for a NOT NULL column", text))
        if c.column in keys:
            identity += [F.lit(c.column), text]
            named.append((c.column, text))
            no_key.append(result.isNull())
    if malformed:
        found.append((F.col(MALFORMED).isNotNull(), None, "MALFORMED_RECORD",
                      "Not as many cells as the header", F.col(MALFORMED)))
    any_error = functools.reduce(lambda a, b: a | b, [when for when, *_ in found])
    errors = F.when(any_error, F.array_compact(F.array(*[_error(*e) for e in found])))
    if identity:
        wanted = functools.reduce(lambda a, b: a | b, [any_error, *no_key])
        pairs = F.when(wanted, F.create_map(*identity))
    else:
        pairs = F.lit(None).cast("map<string,string>")
    texts = [F.struct(*[text.alias(name) for name, text in named]).alias(KEY_TEXT)] if key_text and named else []
    extra = [F.col(name) for name in raw.columns[len(columns):] if name != MALFORMED]
    return cast.select(
        *[F.col(f"_c{i}").alias(c.column) for i, c in enumerate(columns)],
        errors.alias(ERRORS), pairs.alias(IDENTITY), *texts, *extra)


def fit_target(evaluated: DataFrame, target: T.StructType, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Evaluated rows with the types of the table they go to, where the mappings say others.

    A value that does not fit there is NULL and one more error of its row.
    """
    have = {f.name: f.dataType for f in evaluated.schema.fields}
    want = {f.name: f.dataType for f in target.fields}
    other = [c for c in columns if want.get(c, have[c]) != have[c]]
    if not other:
        return evaluated
    wide = evaluated.select("*", *[fitted(F.col(c), want[c], have[c]).alias(f"_fit_{c}") for c in other])
    lost = {c: cast_failed(F.col(c), F.col(f"_fit_{c}"), have[c]) for c in other}
    any_lost = functools.reduce(lambda a, b: a | b, lost.values())
    new = F.array_compact(F.array(*[
        _error(when, c, "CAST_FAILED", f"Does not fit {want[c].simpleString()}", as_text(F.col(c), have[c]))
        for c, when in lost.items()]))
    before = F.coalesce(F.col(ERRORS), F.array().cast(have[ERRORS]))
    identity = F.col(IDENTITY)
    if keys:
        pairs = [part for k in keys for part in (F.lit(k), as_text(F.col(k), have[k]))]
        identity = F.when(any_lost & identity.isNull(), F.create_map(*pairs)).otherwise(identity)
    changed = {ERRORS: F.when(any_lost, F.concat(before, new)).otherwise(F.col(ERRORS)), IDENTITY: identity,
               **{c: F.col(f"_fit_{c}") for c in other}}
    return wide.select(*[changed.get(c, F.col(c)).alias(c) for c in evaluated.columns])


def _error(when: Column, column: str | None, code: str, message: str, value: Column) -> Column:
    return F.when(when, F.struct(
        F.lit(column).cast("string").alias("target_column"), F.lit(code).alias("error_code"),
        F.lit(message).alias("message"), value.alias("raw_value")))


def align(df: DataFrame, target: T.StructType, columns: Sequence[ColumnMap] = ()) -> DataFrame:
    """One value per target column: its mapping if there is one, else the same-named source column
    cast to the target type, else NULL."""
    mapped = {c.column: c for c in columns}
    here = {name.lower(): name for name in df.columns}
    plan = []
    for field in target.fields:
        if field.name in mapped:
            plan.append(mapped[field.name])
        elif field.name.lower() in here:
            plan.append(ColumnMap(field.name, "DIRECT", here[field.name.lower()],
                                  type_name(field.dataType), field.nullable))
        else:
            plan.append(ColumnMap(field.name, "CONSTANT", "NULL", type_name(field.dataType), field.nullable))
    return project(df, plan)
