"""Safe casts: a value that does not fit the target type becomes NULL, never an error."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The accepted texts.
INTEGER_PATTERN = r"^-?[0-9]+$"
NUMBER_PATTERN = r"^-?[0-9]+(\.[0-9]+)?$"
UUID_PATTERN = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
TIME_PATTERN = r"^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$"
DATE_PATTERN = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
DATETIME_PATTERN = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"
DEFAULT_DECIMAL = (10, 0)

TEXT_TYPES = ("VARCHAR", "CHAR", "TEXT")
INTEGER_TYPES = {"INT": "int", "INTEGER": "int", "BIGINT": "bigint"}
FLOAT_TYPES = ("DOUBLE", "FLOAT")


def parse_type(name: str) -> tuple[str, tuple[int, ...]]:
    """``' decimal (12, 4) '`` -> ``('DECIMAL', (12, 4))``."""
    m = re.fullmatch(r"\s*([A-Za-z]+)\s*(?:\(([\d\s,]*)\))?\s*", name)
    if not m:
        raise ValueError(f"not a type name: {name!r}")
    return m[1].upper(), tuple(int(n) for n in (m[2] or "").split(",") if n.strip())


def spark_type(name: str) -> T.DataType:
    """The type that ``safe_cast`` to ``name`` gives."""
    base, args = parse_type(name)
    if base in TEXT_TYPES or base in ("UUID", "JSON", "TIME"):
        return T.StringType()
    if base in INTEGER_TYPES:
        return T.LongType() if base == "BIGINT" else T.IntegerType()
    if base == "DECIMAL":
        precision, scale = (*args, 0)[:2] if args else DEFAULT_DECIMAL
        return T.DecimalType(precision, scale)
    if base in FLOAT_TYPES:
        return T.DoubleType()
    if base == "DATE":
        return T.DateType()
    if base == "DATETIME":
        return T.TimestampNTZType()
    if base == "TIMESTAMP":
        return T.TimestampType()
    raise ValueError(f"no cast to {name!r}")


def type_name(data_type: T.DataType) -> str:
    """The cast type name that keeps a Spark type (the opposite of ``spark_type``)."""
    if isinstance(data_type, T.DecimalType):
        return f"DECIMAL({data_type.precision},{data_type.scale})"
    names = {
        T.StringType: "TEXT", T.IntegerType: "INT", T.LongType: "BIGINT", T.DoubleType: "DOUBLE",
        T.FloatType: "DOUBLE", T.DateType: "DATE", T.TimestampNTZType: "DATETIME",
        T.TimestampType: "TIMESTAMP", T.ShortType: "INT", T.ByteType: "INT", T.BooleanType: "INT",
    }
    if type(data_type) not in names:
        raise ValueError(f"no cast type for {data_type.simpleString()}")
    return names[type(data_type)]


def as_text(value: Column, source: T.DataType | None = None) -> Column:
    """The value as untrimmed text.

    Doubles print as plain digits (``12`` and ``12345678.9``, not ``12.0`` and ``1.23456789E7``),
    truth values as 1 and 0.
    """
    if isinstance(source, T.BooleanType):
        return value.cast("int").cast("string")
    if isinstance(source, (T.DoubleType, T.FloatType)):
        number = value.cast("double")
        plain = F.regexp_replace(number.try_cast("decimal(38,17)").cast("string"), r"0+$", "")
        whole = (number == F.rint(number)) & (F.abs(number) < 1e15)
        outside = ((F.abs(number) >= 1e7) & (F.abs(number) < 1e15)) | (F.abs(number) < 1e-3)
        return (F.when(whole, number.try_cast("bigint").cast("string"))
                .when(outside, plain)
                .otherwise(value.cast("string")))
    return value.cast("string")


def _clean(value: Column, source: T.DataType | None) -> Column:
    """Trimmed text, NULL when blank."""
    return F.nullif(F.trim(as_text(value, source)), F.lit(""))


def _when_like(text: Column, pattern: str, then: Column) -> Column:
    # the pattern keeps text of another form away from the parser, whose refusals cost far more
    return F.when(text.rlike(pattern), then)


def safe_cast(value: Column, to: str, source: T.DataType | None = None) -> Column:
    """``value`` as type ``to``; blank, malformed or overflowing values become NULL.

    ``source`` is the type of ``value`` when it is known; without it the value goes through text.
    """
    base, _ = parse_type(to)
    target = spark_type(to)
    sql_type = target.simpleString()
    if isinstance(source, T.BooleanType):
        value, source = value.cast("int"), T.IntegerType()
    is_float = isinstance(source, (T.DoubleType, T.FloatType))
    is_number = isinstance(source, T.NumericType)
    is_moment = isinstance(source, (T.DateType, T.TimestampType, T.TimestampNTZType))
    text = _clean(value, source)

    if base in TEXT_TYPES:
        return text
    if base == "UUID":
        return _when_like(text, UUID_PATTERN, text)
    if base in INTEGER_TYPES:
        top = 2 ** (63 if base == "BIGINT" else 31)
        if is_float:
            # -top is a double, top - 1 need not be
            return F.when((value == F.rint(value)) & (value >= -float(top)) & (value < float(top)),
                          value.try_cast(sql_type))
        if isinstance(source, T.IntegralType):
            if isinstance(target, T.LongType) or not isinstance(source, T.LongType):
                return value.cast(sql_type)
            return F.when(value.between(-top, top - 1), value.try_cast(sql_type))
        return _when_like(text, INTEGER_PATTERN, text.try_cast(sql_type))
    if base == "DECIMAL":
        # values with too many digits are kept away from the cast for the same reason as bad dates
        whole = target.precision - target.scale
        if is_float:
            return F.when(F.abs(value) < F.lit(float(10 ** whole)), value.try_cast(sql_type))
        if is_number:  # exact: a bound as a double would take the greatest numbers for too large
            return value.try_cast(sql_type)
        fits = text.rlike(rf"^-?0*[0-9]{{0,{whole}}}(\.[0-9]+)?$")
        return F.when(fits & text.rlike(NUMBER_PATTERN), text.try_cast(sql_type))
    if base in FLOAT_TYPES:
        if is_number:
            return value.cast(sql_type)
        return _when_like(text, NUMBER_PATTERN, text.try_cast(sql_type))
    if base == "DATE":
        if is_moment:
            return value.cast("date")
        return _when_like(text, DATE_PATTERN, text.try_cast("date"))
    if base == "DATETIME":
        if is_moment:
            return value.cast("timestamp_ntz")
        return _when_like(text, DATETIME_PATTERN, text.try_cast("timestamp_ntz"))
    if base == "TIMESTAMP":
        if is_moment:
            return value.cast("timestamp")
        return _when_like(text, DATETIME_PATTERN, text.try_cast("timestamp"))
    if base == "JSON":
        return F.when(F.try_parse_json(text).isNotNull(), text)
    # TIME
    if isinstance(source, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, "HH:mm:ss")
    return _when_like(text, TIME_PATTERN, text)


def fitted(value: Column, to: T.DataType, source: T.DataType) -> Column:
    """``value`` as the type a table has; NULL when it does not fit."""
    if to == source:
        return value
    try:
        return safe_cast(value, type_name(to), source).try_cast(to)
    except ValueError:  # a type that no mapping can name
        return value.try_cast(to)


def has_value(value: Column, source: T.DataType | None = None) -> Column:
    """True for what is neither NULL nor blank text."""
    if source is None or isinstance(source, T.StringType):
        return F.coalesce(F.trim(value.cast("string")) != "", F.lit(False))
    return value.isNotNull()


def cast_failed(value: Column, cast: Column, source: T.DataType | None = None) -> Column:
    """True where a value was lost by its cast."""
    return cast.isNull() & has_value(value, source)
