from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from rowferry.functions.expressions import date_pattern, expression, spark_text


@pytest.mark.parametrize("text,wanted", [
    ("LENGTH('é')", 2), ("length( 'abc' )", 3), ("'LENGTH(x) / 0'", "LENGTH(x) / 0"),
    ("7 / 0", None), ("7 % 0", None), ("7 % 4", 3), ("8 / 4 / 2", 1.0), ("8 / (4 / 2)", 4.0), ("1 + 6 / 3 * 2", 5.0),
    ("6 / CASE WHEN 1 = 1 THEN 0 ELSE 1 END", None), ("6 / -2", -3.0), ("-6 / ABS(-2)", -3.0), ("10 / 1e1", 1.0),
    ("CAST('abc' AS SIGNED)", None), ("CAST('12' AS SIGNED)", 12), ("CAST(12 AS CHAR)", "12"), ("CAST(12 AS CHAR(5))", "12"),
    ("CAST('1.25' AS DECIMAL(5,1))", Decimal("1.3")), ("CAST(CAST('7' AS SIGNED) AS CHAR)", "7"),
    ("DATE('2024-01-02 03:04:05')", dt.date(2024, 1, 2)), ("DATE('x')", None), ("DATE '2024-01-02'", dt.date(2024, 1, 2)),
    ("DATE_FORMAT('2024-01-02 03:04:05', '%Y/%m/%d %H-%i-%s')", "2024/01/02 03-04-05"),
    ("DATE_FORMAT('2024-01-02', '%e.%c.%y')", "2.1.24"), ("DATE_FORMAT('2024-01-02', '%YQ at %T')", "2024Q at 00:00:00"),
    ("DATE_FORMAT('x', '%Y')", None), ("DATE_FORMAT('2024-01-02', 'yyyy')", "2024"),
    ("STR_TO_DATE('2/1/2024', '%d/%m/%Y')", dt.date(2024, 1, 2)), ("STR_TO_DATE('31/2/2024', '%d/%m/%Y')", None),
    ("STR_TO_DATE('2024-01-02 3:04:05', '%Y-%m-%d %H:%i:%s')", dt.datetime(2024, 1, 2, 3, 4, 5)),
    ("CONCAT('a', NULL)", None), ("CONCAT('a', 1)", "a1"), ("IF(1 > 2, 'y', 'n')", "n"), ("IFNULL(NULL, 'z')", "z"),
    ("LPAD('abc', 2, '*')", "ab"), ("REGEXP_REPLACE('a1b22', '[0-9]', '')", "ab"), ("SUBSTRING('abcdef', -3, 2)", "de"),
    ("TRIM('  a\t ')", "a\t"), ("ROUND(CAST('2.5' AS DECIMAL(3,1)), 0)", Decimal("3")), ("REPLACE('aXa', 'X', '%')", "a%a"),
    ("LEFT('abc', 2)", "ab"), ("RIGHT('abc', 2)", "bc"), ("NULLIF(1, 1)", None), ("'it''s'", "it's"),
    ("CAST('abcdef' AS CHAR(3))", "abc"), ("STR_TO_DATE('1/2/70', '%d/%m/%y')", dt.date(1970, 2, 1)),
    ("STR_TO_DATE('1/2/69', '%d/%m/%y')", dt.date(2069, 2, 1)), ("SUBSTRING('abc', 0)", ""), ("SUBSTR('abc', 0, 2)", ""),
    ("SUBSTRING('abc', -5, 3)", ""), ("SUBSTRING('abc', 1 + 1)", "bc"), ("SUBSTRING(CONCAT('a', ',b'), 2)", ",b"),
    ("SUBSTRING('abc', NULL)", None), ("SUBSTRING(NULL, 0)", None),
    ("'50%' LIKE '%0!%' ESCAPE '!'", True), ("'a/b'", "a/b"),
])
def test_meaning(spark, text, wanted):
    got = spark.range(1).select(expression(text)).first()[0]
    assert got == wanted and type(got) is type(wanted)


def test_columns_named_like_functions_are_left_alone(spark):
    df = spark.createDataFrame([(3, 0)], "length int, date int").alias("t")
    assert df.select(expression("t.length + length"), expression("t.length / t.date"), expression("date")).first() == (6, None, 0)


def test_patterns():
    assert date_pattern("%Y-%m-%dT%H:%i:%s") == "yyyy-MM-dd'T'HH:mm:ss"
    assert date_pattern("100%%") == "100%"
    with pytest.raises(ValueError):
        date_pattern("%Q")
    with pytest.raises(ValueError):
        spark_text("DATE_FORMAT(x, y)")
    with pytest.raises(ValueError):
        spark_text("LENGTH(x")
