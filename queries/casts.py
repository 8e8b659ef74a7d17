"""Safe casts of dirty text. The text is made by one expression, the same in Spark and in SQL."""

from __future__ import annotations

from queries.common import maps, run, step, table

NUMBERS = """CASE o_orderkey % 13 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN ' 12 ' WHEN 3 THEN '12.7' WHEN 4 THEN '+5'
 WHEN 5 THEN '1e3' WHEN 6 THEN '99999999999999999999' WHEN 7 THEN 'abc' WHEN 8 THEN '-0042' WHEN 9 THEN '12.34567'
 WHEN 10 THEN '-.5' WHEN 11 THEN '3000000000' ELSE concat('', o_custkey) END"""
UUIDS = """CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN ' 123E4567-e89b-12d3-a456-426614174000 '
 WHEN 2 THEN '123e4567e89b12d3a456426614174000' WHEN 3 THEN 'g23e4567-e89b-12d3-a456-426614174000' WHEN 4 THEN o_orderpriority
 ELSE concat('00000000-0000-0000-0000-', lpad(concat('', o_custkey), 12, '0')) END"""
DAYS = """CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN '2024-1-2' WHEN 2 THEN '2024-13-02' WHEN 3 THEN ' 2024-02-29 '
 WHEN 4 THEN '2023-02-29' WHEN 5 THEN 'soon' ELSE concat('20', 10 + o_custkey % 80, '-05-', 10 + o_custkey % 20) END"""
MOMENTS = """CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN '2024-1-2 3:4:5' WHEN 2 THEN '2024-01-02 25:00:00'
 WHEN 3 THEN ' 2024-02-29 23:59:59 ' WHEN 4 THEN '2023-02-29 00:00:00' WHEN 5 THEN 'soon'
 ELSE concat('20', 10 + o_custkey % 80, '-05-', 10 + o_custkey % 20, ' 07:08:09') END"""
CLOCKS = """CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN ' 23:59:59 ' WHEN 2 THEN '24:00:00' WHEN 3 THEN '7:08:09'
 WHEN 4 THEN 'noon' ELSE concat('0', o_custkey % 10, ':15:30') END"""


def _orders(text: str, *columns: tuple[str, str]):
    def query(spark, sf):
        wanted = maps(("id", "DIRECT", "o.o_orderkey", "BIGINT"),
                      *[(name, "DERIVED", "derivations.dirty", to) for name, to in columns])
        return run(step("o", wanted, derivations={"dirty": text}), o=table(spark, sf, "orders"))
    return query


def _text_of(query, *columns):
    """Dates and times as text, so that both engines print them alike."""
    def as_text(spark, sf):
        df = query(spark, sf)
        return df.withColumns({c: df[c].cast("string") for c in columns})
    return as_text


def cast_numbers(spark, sf):
    """Casts of values that already have a number type."""
    return run(step("l", maps(
        ("order_key", "DIRECT", "l.l_orderkey", "BIGINT"), ("line", "DIRECT", "l.l_linenumber", "TEXT"),
        ("quantity", "DIRECT", "l.l_quantity", "INT"), ("price_int", "DIRECT", "l.l_extendedprice", "BIGINT"),
        ("price", "DIRECT", "l.l_extendedprice", "DECIMAL(12,1)"), ("small", "DIRECT", "l.l_extendedprice", "DECIMAL(6,2)"),
        ("order_text", "DIRECT", "l.l_orderkey", "VARCHAR(2)"), ("qty_text", "DIRECT", "l.l_quantity", "CHAR(5)"),
        ("day", "EXPRESSION", "l.l_shipdate", "DATE"), ("returned", "EXPRESSION", "l.l_returnflag = 'R'", "INT"),
        ("no_date", "DIRECT", "l.l_orderkey", "DATE"))), l=table(spark, sf, "lineitem"))


def cast_json_time(spark, sf):
    """JSON of the events and clock times of the orders' text, over the whole events table."""
    clocks = CLOCKS.replace("o_orderkey", "e.event_id").replace("o_custkey", "e.user_id")
    return run(step("e", maps(
        ("id", "DIRECT", "e.event_id", "BIGINT"), ("props", "DIRECT", "e.props", "JSON"),
        ("broken", "EXPRESSION", "CASE WHEN e.user_id % 2 = 0 THEN e.props ELSE CONCAT('{', e.event_type) END", "JSON"),
        ("clock", "EXPRESSION", clocks, "TIME"), ("of_moment", "DIRECT", "e.ts", "TIME"))),
        e=table(spark, sf, "events"))


QUERIES = {
    "cast_string": _orders(NUMBERS, ("text", "TEXT"), ("varchar3", "VARCHAR(3)"), ("char1", "CHAR(1)")),
    "cast_uuid": _orders(UUIDS, ("uuid", "UUID")),
    "cast_int": _orders(NUMBERS, ("i", "INT"), ("ii", "INTEGER"), ("b", "BIGINT")),
    "cast_decimal": _orders(NUMBERS, ("d4", " decimal (12, 4)"), ("d0", "DECIMAL(10)"), ("tight", "DECIMAL(4,2)")),
    "cast_double": _orders(NUMBERS, ("d", "DOUBLE"), ("f", "FLOAT")),
    "cast_date": _text_of(_orders(DAYS, ("day", "DATE")), "day"),
    "cast_timestamp": _text_of(_orders(MOMENTS, ("dt", "DATETIME"), ("ts", "TIMESTAMP")), "dt", "ts"),
    "cast_numbers": _text_of(cast_numbers, "day", "no_date"),
    "cast_json_time": cast_json_time,
}

_DIRTY = "SELECT o_orderkey AS id, {columns} FROM (SELECT *, nullif(trim({text}), '') AS t FROM orders)"
_INTEGER = "regexp_full_match(t, '-?[0-9]+')"
_NUMBER = r"regexp_full_match(t, '-?[0-9]+(\.[0-9]+)?')"


def _sql(text: str, columns: str) -> str:
    return _DIRTY.format(text=text, columns=columns)


ORACLE = {
    "cast_string": _sql(NUMBERS, "t AS text, t AS varchar3, t AS char1"),
    "cast_uuid": _sql(UUIDS, "CASE WHEN regexp_full_match(t, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}') THEN t END AS uuid"
                      .replace("{{", "{").replace("}}", "}")),
    "cast_int": _sql(NUMBERS, f"""CASE WHEN {_INTEGER} THEN try_cast(t AS INT) END AS i,
        CASE WHEN {_INTEGER} THEN try_cast(t AS INT) END AS ii, CASE WHEN {_INTEGER} THEN try_cast(t AS BIGINT) END AS b"""),
    "cast_decimal": _sql(NUMBERS, f"""CASE WHEN {_NUMBER} THEN try_cast(t AS DECIMAL(12,4)) END AS d4,
        CASE WHEN {_NUMBER} THEN try_cast(t AS DECIMAL(10,0)) END AS d0, CASE WHEN {_NUMBER} THEN try_cast(t AS DECIMAL(4,2)) END AS tight"""),
    "cast_double": _sql(NUMBERS, f"""CASE WHEN {_NUMBER} THEN try_cast(t AS DOUBLE) END AS d,
        CASE WHEN {_NUMBER} THEN try_cast(t AS DOUBLE) END AS f"""),
    "cast_date": _sql(DAYS, "try_strptime(t, '%Y-%m-%d')::DATE::VARCHAR AS day"),
    "cast_timestamp": _sql(MOMENTS, """strftime(try_strptime(t, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS dt,
        strftime(try_strptime(t, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS ts"""),
    "cast_numbers": """
        SELECT l_orderkey AS order_key, l_linenumber::VARCHAR AS line,
               CASE WHEN l_quantity = floor(l_quantity) THEN l_quantity::INT END AS quantity,
               CASE WHEN l_extendedprice = floor(l_extendedprice) THEN l_extendedprice::BIGINT END AS price_int,
               l_extendedprice::DECIMAL(12,2)::DECIMAL(12,1) AS price, try_cast(l_extendedprice AS DECIMAL(6,2)) AS small,
               l_orderkey::VARCHAR AS order_text, l_quantity::BIGINT::VARCHAR AS qty_text,
               l_shipdate::DATE::VARCHAR AS day, (l_returnflag = 'R')::INT AS returned, NULL::VARCHAR AS no_date
        FROM lineitem""",
    "cast_json_time": f"""
        SELECT event_id AS id, props, CASE WHEN user_id % 2 = 0 THEN props END AS broken,
               CASE WHEN regexp_full_match(clock, '([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]') THEN clock END AS clock,
               strftime(ts, '%H:%M:%S') AS of_moment
        FROM (SELECT *, trim({CLOCKS.replace('o_orderkey', 'event_id').replace('o_custkey', 'user_id')}) AS clock FROM events)""",
}
