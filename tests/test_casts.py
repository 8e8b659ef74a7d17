"""Safe casts against a table of awkward values, and against the type each has."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.casts import as_text, parse_type, safe_cast, spark_type

TEXTS = ["", "   ", None, " 12 ", "12.7", "+5", "1e3", "-0042", "99999999999999999999", "3000000000", "abc", "\t7",
         "-", ".5", "5.", "-12.34567", "2024-1-2", "2024-02-29", "2023-02-29", "2024-13-01", "2024-01-02 03:04:05",
         "2024-1-2 3:4:5", "2024-01-02 25:00:00", "23:59:59", "24:00:00", '{"a":1}', "{a", "[1, 2]",
         "123E4567-e89b-12d3-a456-426614174000", "123e4567e89b12d3a456426614174000"]

# what survives each cast; every other text becomes NULL
SURVIVORS = {
    "INT": {" 12 ": 12, "-0042": -42},
    "BIGINT": {" 12 ": 12, "-0042": -42, "3000000000": 3000000000},
    "DECIMAL(12,4)": {" 12 ": Decimal("12.0000"), "12.7": Decimal("12.7000"), "-0042": Decimal("-42.0000"),
                      "-12.34567": Decimal("-12.3457")},
    "DECIMAL(4,2)": {" 12 ": Decimal("12.00"), "12.7": Decimal("12.70"), "-0042": Decimal("-42.00"),
                     "-12.34567": Decimal("-12.35")},
    "DOUBLE": {" 12 ": 12.0, "12.7": 12.7, "-0042": -42.0, "99999999999999999999": 1e20, "3000000000": 3e9,
               "-12.34567": -12.34567},
    "DATE": {"2024-1-2": dt.date(2024, 1, 2), "2024-02-29": dt.date(2024, 2, 29)},
    "DATETIME": {"2024-01-02 03:04:05": dt.datetime(2024, 1, 2, 3, 4, 5), "2024-1-2 3:4:5": dt.datetime(2024, 1, 2, 3, 4, 5)},
    "TIMESTAMP": {"2024-01-02 03:04:05": dt.datetime(2024, 1, 2, 3, 4, 5), "2024-1-2 3:4:5": dt.datetime(2024, 1, 2, 3, 4, 5)},
    "TIME": {"23:59:59": "23:59:59"},
    "UUID": {"123E4567-e89b-12d3-a456-426614174000": "123E4567-e89b-12d3-a456-426614174000"},
}
SURVIVORS["FLOAT"] = SURVIVORS["DOUBLE"]
SURVIVORS["INTEGER"] = SURVIVORS["INT"]


@pytest.mark.parametrize("name", sorted(SURVIVORS))
def test_text(spark, name):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for source in (None, T.StringType()):
        got = {r[0]: r[1] for r in df.select("t", safe_cast(F.col("t"), name, source)).collect()}
        assert got == {t: SURVIVORS[name].get(t) for t in TEXTS}


@pytest.mark.parametrize("name", ["VARCHAR(3)", "CHAR(1)", "TEXT", "varchar (255)"])
def test_text_is_trimmed_not_cut(spark, name):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {r[0]: r[1] for r in df.select("t", safe_cast(F.col("t"), name)).collect()}
    assert got == {t: (t.strip(" ") or None) if t is not None else None for t in TEXTS}


def test_json_keeps_its_text(spark):
    df = spark.createDataFrame([(t,) for t in ['{"a":1}', " [1, 2] ", "{a", "", None, "nope", "3"]], "t string")
    got = [r[0] for r in df.select(safe_cast(F.col("t"), "JSON")).collect()]
    assert got == ['{"a":1}', "[1, 2]", None, None, None, None, "3"]


@pytest.mark.parametrize("value,source,name,wanted", [
    (12.0, "double", "INT", 12), (12.7, "double", "INT", None), (3e9, "double", "INT", None),
    (float(2 ** 31), "double", "INT", None), (-float(2 ** 31), "double", "INT", -(2 ** 31)),
    (1e300, "double", "BIGINT", None), (float("nan"), "double", "BIGINT", None), (2.0 ** 63, "double", "BIGINT", None),
    (12.0, "double", "TEXT", "12"), (12345678.9, "double", "TEXT", "12345678.9"), (0.00012, "double", "TEXT", "0.00012"),
    (0.5, "double", "TEXT", "0.5"), (0.0, "double", "TEXT", "0"), (-7.25, "double", "VARCHAR(9)", "-7.25"),
    (1e9, "double", "DECIMAL(12,2)", Decimal("1000000000.00")),
    (1e10, "double", "DECIMAL(12,2)", None), (1e10, "double", "DOUBLE", 1e10), (float("inf"), "double", "DECIMAL(5,1)", None),
    (3000000000, "bigint", "INT", None), (-3, "bigint", "INT", -3), (7, "int", "BIGINT", 7), (7, "int", "TEXT", "7"),
    (123456, "bigint", "DECIMAL(5,0)", None), (99999, "bigint", "DECIMAL(5,0)", Decimal("99999")),
    (Decimal("99.96"), "decimal(4,2)", "DECIMAL(3,1)", None), (Decimal("99.94"), "decimal(4,2)", "DECIMAL(3,1)", Decimal("99.9")),
    (Decimal("12.00"), "decimal(4,2)", "INT", None), (Decimal("12"), "decimal(4,0)", "INT", 12),
    (True, "boolean", "INT", 1), (False, "boolean", "TEXT", "0"), (20240102, "int", "DATE", None),
    (dt.datetime(2024, 1, 2, 3, 4, 5), "timestamp_ntz", "DATE", dt.date(2024, 1, 2)),
    (dt.datetime(2024, 1, 2, 3, 4, 5), "timestamp_ntz", "TIME", "03:04:05"),
    (dt.datetime(2024, 1, 2, 3, 4, 5), "timestamp_ntz", "DATETIME", dt.datetime(2024, 1, 2, 3, 4, 5)),
    (dt.date(2024, 1, 2), "date", "DATETIME", dt.datetime(2024, 1, 2)), (dt.date(2024, 1, 2), "date", "TEXT", "2024-01-02"),
])
def test_typed_input(spark, value, source, name, wanted):
    df = spark.createDataFrame([(value,)], f"v {source}")
    assert df.select(safe_cast(F.col("v"), name, df.schema["v"].dataType)).first()[0] == wanted


def test_result_type_is_the_declared_one(spark):
    df = spark.createDataFrame([("1",)], "t string")
    for name in ("INT", "BIGINT", "DECIMAL(12,4)", "DOUBLE", "DATE", "DATETIME", "TIMESTAMP", "JSON", "TIME", "UUID", "TEXT"):
        assert df.select(safe_cast(F.col("t"), name).alias("x")).schema["x"].dataType == spark_type(name)


def test_type_names():
    assert parse_type(" decimal ( 12 , 4 ) ") == ("DECIMAL", (12, 4))
    assert parse_type("int") == ("INT", ())
    with pytest.raises(ValueError):
        spark_type("BLOB")
    with pytest.raises(ValueError):
        parse_type("VARCHAR(")


def test_large_decimal_digits_survive_as_text(spark):
    df = spark.createDataFrame([(123456789.125,), (-98765432.5,)], "v double")
    got = [r[0] for r in df.select(as_text(F.col("v"), T.DoubleType())).collect()]
    assert got == ["123456789.125", "-98765432.5"]
