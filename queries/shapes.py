"""Filters, chunks, derivations, mappings, functions and predicates."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from queries.common import expressions, join, maps, run, step, table
from rowferry.operators.chunks import chunk_bounds, chunk_filter, chunk_plan
from rowferry.operators.shape import align
from rowferry.sources.open import open_sources
from rowferry.spec import Connection

ORDER_COLUMNS = maps(
    ("order_key", "DIRECT", "o.o_orderkey", "BIGINT"),
    ("status", "DIRECT", "o.o_orderstatus", "CHAR(1)"),
    ("price", "DIRECT", "o.o_totalprice", "DECIMAL(12,2)"))


def pre_filter(spark, sf):
    s = step("o", ORDER_COLUMNS, pre_filters=["o.o_orderstatus = 'F'", "o.o_orderdate >= '1997-01-01'"])
    return run(s, o=table(spark, sf, "orders"))


def post_filter(spark, sf):
    s = step("o", (*ORDER_COLUMNS, *maps(("doubled", "DERIVED", "derivations.doubled", "DECIMAL(14,2)"))),
             derivations={"doubled": "CAST(o.o_totalprice AS DECIMAL(12,2)) * 2"},
             post_filters=["doubled > 500000", "o.o_orderpriority LIKE '%HIGH'"])
    return run(s, o=table(spark, sf, "orders"))


def chunk_filter_query(spark, sf):
    orders = table(spark, sf, "orders")
    hi = chunk_bounds(orders, "o_orderkey", 0).first()["hi"]
    size = -(-hi // 4)
    parts = [chunk_filter(orders, "o_orderkey", i * size, size).withColumn("chunk", F.lit(i + 1)) for i in range(4)]
    every = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return every.groupBy(F.col("chunk").cast("bigint").alias("chunk")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("min_key"), F.sum("o_orderkey").alias("key_sum"))


def chunk_plan_query(spark, sf):
    return chunk_plan(table(spark, sf, "orders"), "o_orderkey", 2500)


def chunk_bounds_query(spark, sf):
    orders = table(spark, sf, "orders")
    named = lambda lower, name: chunk_bounds(orders, "o_orderkey", lower).withColumn("kind", F.lit(name))
    return named(None, "all keys").unionByName(named(0, "keys above 0"))


def derivations(spark, sf):
    s = step("c", maps(
        ("id", "DIRECT", "c.c_custkey", "BIGINT"),
        ("digits", "DERIVED", "derivations.digits", "VARCHAR(32)"),
        ("level", "DERIVED", "derivations.level", "TEXT"),
        ("label", "EXPRESSION", "CONCAT(derivations.level, '/', n.n_name)", "TEXT")),
        joins=[join("n", "LEFT", ("n.n_nationkey", "=", "c.c_nationkey"))],
        derivations={"digits": "REGEXP_REPLACE(c.c_name, '[^0-9]', '')",
                     "level": "CASE WHEN c.c_acctbal >= 5000 THEN 'high' WHEN c.c_acctbal >= 0 THEN 'mid' ELSE 'low' END"})
    return run(s, c=table(spark, sf, "customer"), n=table(spark, sf, "nation"))


def _customer_step(columns, **parts):
    return step("c", columns, joins=[join("n", "LEFT", ("n.n_nationkey", "=", "c.c_nationkey"))], **parts)


def _customers(spark, sf, columns, **parts):
    return run(_customer_step(columns, **parts), c=table(spark, sf, "customer"), n=table(spark, sf, "nation"))


def map_direct(spark, sf):
    return _customers(spark, sf, maps(
        ("id", "DIRECT", "c.c_custkey", "BIGINT"), ("name", "DIRECT", "c.c_name", "VARCHAR(255)"),
        ("nation", "DIRECT", "n.n_name", "VARCHAR(64)"), ("region_key", "DIRECT", "n.n_regionkey", "INT")))


def map_derived(spark, sf):
    return _customers(spark, sf, maps(
        ("id", "DIRECT", "c.c_custkey", "BIGINT"), ("c_name", "DERIVED", "derivations.c_name", "TEXT")),
        derivations={"c_name": "UPPER(CONCAT(n.n_name, ':', c.c_name))"})


def map_expression(spark, sf):
    return _customers(spark, sf, maps(
        ("id", "DIRECT", "c.c_custkey", "BIGINT"),
        ("owed", "EXPRESSION", "CASE WHEN derivations.cents < 0 THEN 0 - derivations.cents ELSE derivations.cents * 0.25 END",
         "DECIMAL(12,4)"),
        ("place", "EXPRESSION", "COALESCE(n.n_name, 'none')", "VARCHAR(64)")),
        derivations={"cents": "CAST(c.c_acctbal AS DECIMAL(12,2))"})


def map_constant(spark, sf):
    return _customers(spark, sf, maps(
        ("id", "DIRECT", "c.c_custkey", "BIGINT"), ("origin", "CONSTANT", "'TESTDATA'", "VARCHAR(64)"),
        ("one", "CONSTANT", "1", "INT"), ("rate", "CONSTANT", "0.25", "DECIMAL(5,3)"),
        ("nothing", "CONSTANT", "NULL", "TEXT")))


def projection(spark, sf):
    return _customers(spark, sf, maps(
        ("zone", "DIRECT", "n.n_regionkey", "BIGINT"), ("balance", "DIRECT", "c.c_acctbal", "DECIMAL(12,4)"),
        ("id", "DIRECT", "c.c_custkey", "INT"), ("balance_text", "DIRECT", "c.c_acctbal", "TEXT")))


def align_schema(spark, sf):
    target = spark.createDataFrame(
        [], "c_custkey string, C_NAME string, c_acctbal decimal(12,1), c_phone string, segment string, c_nationkey bigint").schema
    return align(table(spark, sf, "customer"), target, maps(("segment", "EXPRESSION", "LOWER(c_mktsegment)", "TEXT")))


# Scalar functions -----------------------------------------------------------------------------

def fn_text(spark, sf):
    return expressions(
        spark, sf, "part", "p",
        ("id", "p.p_partkey", "BIGINT"),
        ("low", "LOWER(p.p_type)", "TEXT"), ("up", "UPPER(p.p_name)", "TEXT"),
        ("first3", "LEFT(p.p_name, 3)", "TEXT"), ("last3", "RIGHT(p.p_name, 3)", "TEXT"),
        ("from_end", "SUBSTRING(p.p_name, -4, 2)", "TEXT"), ("from_2", "SUBSTRING(p.p_name, 2, 3)", "TEXT"),
        ("left_pad", "LPAD(p.p_type, 8, '*')", "TEXT"), ("cut_pad", "LPAD(p.p_type, 3, '*')", "TEXT"),
        ("right_pad", "RPAD(p.p_type, 9, '-+')", "TEXT"),
        ("swapped", "REPLACE(p.p_brand, 'Brand#', 'B-')", "TEXT"),
        ("trimmed", "CONCAT('[', TRIM(CONCAT('  ', p.p_name, ' ')), ']')", "TEXT"),
        ("joined", "CONCAT(p.p_brand, '/', p.p_size)", "TEXT"))


def fn_null(spark, sf):
    return expressions(
        spark, sf, "part", "p",
        ("id", "p.p_partkey", "BIGINT"),
        ("no_small", "NULLIF(p.p_type, 'SMALL')", "TEXT"),
        ("filled", "IFNULL(NULLIF(p.p_type, 'SMALL'), 'tiny')", "TEXT"),
        ("any", "COALESCE(NULL, NULLIF(p.p_type, 'SMALL'), p.p_brand)", "TEXT"),
        ("null_concat", "CONCAT(p.p_name, NULLIF(p.p_type, 'SMALL'))", "TEXT"),
        ("big", "IF(p.p_size > 25, 'big', 'small')", "TEXT"),
        ("band", "CASE WHEN p.p_size < 10 THEN 1 WHEN p.p_size < 30 THEN 2 ELSE 3 END", "INT"))


def fn_number(spark, sf):
    return expressions(
        spark, sf, "lineitem", "l",
        ("order_key", "l.l_orderkey", "BIGINT"), ("line", "l.l_linenumber", "INT"),
        ("part_key", "l.l_partkey", "BIGINT"),
        ("distance", "ABS(l.l_linenumber - 4)", "INT"),
        ("whole", "ROUND(CAST(l.l_extendedprice AS DECIMAL(12,2)), 0)", "DECIMAL(12,0)"),
        ("one_place", "ROUND(CAST(l.l_extendedprice AS DECIMAL(12,2)) * -1, 1)", "DECIMAL(12,1)"),
        ("per_piece", "CAST(l.l_extendedprice AS DECIMAL(12,2)) / (l.l_linenumber - 4)", "DECIMAL(12,3)"),
        ("rest", "l.l_partkey % (l.l_linenumber - 4)", "BIGINT"),
        ("sum3", "l.l_partkey + l.l_suppkey * 2 - l.l_linenumber", "BIGINT"))


def fn_date(spark, sf):
    return expressions(
        spark, sf, "orders", "o",
        ("id", "o.o_orderkey", "BIGINT"),
        ("day", "CAST(DATE(o.o_orderdate) AS CHAR)", "TEXT"),
        ("month", "DATE_FORMAT(o.o_orderdate, '%Y/%m')", "TEXT"),
        ("long_form", "DATE_FORMAT(o.o_orderdate, '%d.%m.%Y at %H:%i:%s')", "TEXT"),
        ("parsed", "CAST(STR_TO_DATE(DATE_FORMAT(o.o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS CHAR)", "TEXT"),
        ("bad", "CAST(STR_TO_DATE(o.o_orderpriority, '%Y-%m-%d') AS CHAR)", "TEXT"),
        ("moment", "DATE_FORMAT(STR_TO_DATE(CONCAT('2021-3-', o.o_orderkey % 40, ' 4:05:06'), '%Y-%m-%d %H:%i:%s'), '%Y%m%d%H%i%s')",
         "TEXT"))


def fn_regex(spark, sf):
    return expressions(
        spark, sf, "documents", "d",
        ("id", "d.doc_id", "BIGINT"),
        ("digits", "LENGTH(REGEXP_REPLACE(d.text, '[^0-9]', ''))", "BIGINT"),
        ("spaces", "LENGTH(REGEXP_REPLACE(d.text, '[^ ]+', ''))", "BIGINT"),
        ("source", "REGEXP_REPLACE(d.source, '[aeiou]', '*')", "TEXT"))


def fn_bytes(spark, sf):
    return expressions(
        spark, sf, "documents", "d",
        ("id", "d.doc_id", "BIGINT"), ("bytes", "LENGTH(d.text)", "BIGINT"),
        ("extra_bytes", "LENGTH(d.text) - d.n_chars", "BIGINT"), ("lang", "d.lang", "TEXT"))


def predicates(spark, sf):
    return expressions(
        spark, sf, "orders", "o",
        ("id", "o.o_orderkey", "BIGINT"),
        ("eq", "o.o_orderstatus = 'F'", "INT"), ("ne", "o.o_orderstatus != 'F'", "INT"),
        ("ne2", "o.o_custkey <> 5", "INT"), ("lt", "o.o_totalprice < 100000", "INT"),
        ("le", "o.o_orderkey <= o.o_custkey", "INT"), ("gt", "o.o_totalprice > 100000.5", "INT"),
        ("ge", "o.o_custkey >= 700", "INT"),
        ("both", "o.o_orderstatus = 'O' AND NOT (o.o_custkey > 500 OR o.o_custkey < 100)", "INT"),
        ("between_", "o.o_custkey BETWEEN 100 AND 200", "INT"),
        ("in_", "o.o_orderstatus IN ('F', 'P')", "INT"), ("like_", "o.o_orderpriority LIKE '_-%H%'", "INT"),
        ("null_", "NULLIF(o.o_orderstatus, 'F') IS NULL", "INT"),
        ("not_null", "NULLIF(o.o_orderstatus, 'F') IS NOT NULL", "INT"),
        ("unknown", "NULLIF(o.o_orderstatus, 'F') = 'O'", "INT"), ("yes", "TRUE", "INT"), ("no", "FALSE", "INT"))


def _nocase(spark, sf, s):
    """A step whose connections compare text without case."""
    lake = {"data": Connection("PARQUET", sf, {"collation": "UTF8_LCASE"})}
    return run(s, **open_sources(spark, s, lake))


def predicates_nocase(spark, sf):
    return _nocase(spark, sf, _of_table(step("o", ORDER_COLUMNS, pre_filters=[
        "o.o_orderstatus IN ('f', 'O')", "o.o_orderpriority LIKE '%h' OR o.o_orderpriority = '1-urgent' OR o.o_orderpriority >= '5-lo'"],
        derivations={"kind": "CASE o.o_orderstatus WHEN 'o' THEN 1 ELSE 0 END"}, post_filters=["kind = 0 OR o.o_orderpriority <> '1-Urgent'"]), o="orders"))


def join_nocase(spark, sf):
    return _nocase(spark, sf, _of_table(step("c", maps(
        ("id", "DIRECT", "c.c_custkey", "BIGINT"), ("name", "DIRECT", "c.c_name", "TEXT"), ("same", "DIRECT", "d.c_custkey", "BIGINT")),
        joins=[join("d", "LEFT", ("LOWER(d.c_name)", "=", "c.c_name"), ("d.c_mktsegment", "=", "'building'"))]), c="customer", d="customer"))


def _of_table(s, **tables):
    """The step with its sources' aliases standing for tables."""
    return replace(s, root=replace(s.root, table=tables[s.root.alias]),
                   joins=tuple(replace(j, source=replace(j.source, table=tables[j.source.alias])) for j in s.joins))


QUERIES = {
    "predicates_nocase": predicates_nocase, "join_nocase": join_nocase,
    "pre_filter": pre_filter, "post_filter": post_filter, "chunk_filter": chunk_filter_query,
    "chunk_plan": chunk_plan_query, "chunk_bounds": chunk_bounds_query, "derivations": derivations,
    "map_direct": map_direct, "map_derived": map_derived, "map_expression": map_expression,
    "map_constant": map_constant, "projection": projection, "align_schema": align_schema,
    "fn_text": fn_text, "fn_null": fn_null, "fn_number": fn_number, "fn_date": fn_date,
    "fn_regex": fn_regex, "fn_bytes": fn_bytes, "predicates": predicates,
}

ORACLE = {
    "predicates_nocase": """
        SELECT o_orderkey AS order_key, o_orderstatus AS status, o_totalprice::DECIMAL(12,2) AS price FROM orders
        WHERE lower(o_orderstatus) IN ('f', 'o')
          AND (lower(o_orderpriority) LIKE '%h' OR lower(o_orderpriority) = '1-urgent' OR lower(o_orderpriority) >= '5-lo')
          AND (lower(o_orderstatus) <> 'o' OR lower(o_orderpriority) <> '1-urgent')""",
    "join_nocase": """
        SELECT c.c_custkey AS id, c.c_name AS name, d.c_custkey AS same
        FROM customer c LEFT JOIN customer d ON lower(d.c_name) = lower(c.c_name) AND lower(d.c_mktsegment) = 'building'""",
    "pre_filter": """
        SELECT o_orderkey AS order_key, o_orderstatus AS status, o_totalprice::DECIMAL(12,2) AS price
        FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1997-01-01'""",
    "post_filter": """
        SELECT o_orderkey AS order_key, o_orderstatus AS status, o_totalprice::DECIMAL(12,2) AS price,
               (o_totalprice::DECIMAL(12,2) * 2)::DECIMAL(14,2) AS doubled
        FROM orders WHERE o_totalprice::DECIMAL(12,2) * 2 > 500000 AND o_orderpriority LIKE '%HIGH'""",
    "chunk_filter": """
        WITH s AS (SELECT ((max(o_orderkey) + 3) // 4)::BIGINT AS size FROM orders)
        SELECT ((o_orderkey - 1) // size + 1)::BIGINT AS chunk, count(*)::BIGINT AS rows,
               min(o_orderkey) AS min_key, sum(o_orderkey)::BIGINT AS key_sum
        FROM orders, s WHERE o_orderkey > 0 GROUP BY 1""",
    "chunk_plan": """
        WITH b AS (SELECT min(o_orderkey) AS lo FROM orders)
        SELECT ((o_orderkey - lo) // 2500 + 1)::BIGINT AS chunk, min(o_orderkey) AS min_key,
               max(o_orderkey) AS max_key, count(*)::BIGINT AS rows
        FROM orders, b GROUP BY 1""",
    "chunk_bounds": """
        SELECT 'all keys' AS kind, min(o_orderkey) - 1 AS lo, max(o_orderkey) AS hi FROM orders
        UNION ALL SELECT 'keys above 0', 0, max(o_orderkey) FROM orders""",
    "derivations": """
        SELECT c_custkey AS id, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, level,
               level || '/' || n_name AS label
        FROM (SELECT *, CASE WHEN c_acctbal >= 5000 THEN 'high' WHEN c_acctbal >= 0 THEN 'mid' ELSE 'low' END AS level
              FROM customer) LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "map_direct": """
        SELECT c_custkey AS id, c_name AS name, n_name AS nation, n_regionkey AS region_key
        FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "map_derived": """
        SELECT c_custkey AS id, upper(n_name || ':' || c_name) AS c_name
        FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "map_expression": """
        SELECT c_custkey AS id,
               CASE WHEN c_acctbal::DECIMAL(12,2) < 0 THEN -c_acctbal::DECIMAL(12,2) ELSE c_acctbal::DECIMAL(12,2) * 0.25::DECIMAL(3,2) END::DECIMAL(12,4) AS owed,
               coalesce(n_name, 'none') AS place
        FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "map_constant": """
        SELECT c_custkey AS id, 'TESTDATA' AS origin, 1 AS one, 0.250::DECIMAL(5,3) AS rate,
               NULL::VARCHAR AS nothing
        FROM customer""",
    "projection": """
        SELECT n_regionkey::BIGINT AS zone, c_acctbal::DECIMAL(12,4) AS balance, c_custkey::INT AS id,
               CASE WHEN c_acctbal = round(c_acctbal, 0) THEN c_acctbal::BIGINT::VARCHAR ELSE c_acctbal::VARCHAR END AS balance_text
        FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "align_schema": """
        SELECT c_custkey::VARCHAR AS c_custkey, c_name AS C_NAME, c_acctbal::DECIMAL(12,2)::DECIMAL(12,1) AS c_acctbal,
               NULL::VARCHAR AS c_phone, lower(c_mktsegment) AS segment, c_nationkey::BIGINT AS c_nationkey
        FROM customer""",
    "fn_text": """
        SELECT p_partkey AS id, lower(p_type) AS low, upper(p_name) AS up, trim(left(p_name, 3)) AS first3,
               trim(right(p_name, 3)) AS last3, trim(substring(p_name, -4, 2)) AS from_end, trim(substring(p_name, 2, 3)) AS from_2,
               lpad(p_type, 8, '*') AS left_pad, lpad(p_type, 3, '*') AS cut_pad, rpad(p_type, 9, '-+') AS right_pad,
               replace(p_brand, 'Brand#', 'B-') AS swapped, '[' || p_name || ']' AS trimmed,
               p_brand || '/' || p_size::VARCHAR AS joined
        FROM part""",
    "fn_null": """
        SELECT p_partkey AS id, nullif(p_type, 'SMALL') AS no_small, coalesce(nullif(p_type, 'SMALL'), 'tiny') AS filled,
               coalesce(nullif(p_type, 'SMALL'), p_brand) AS "any", p_name || nullif(p_type, 'SMALL') AS null_concat,
               CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS big,
               CASE WHEN p_size < 10 THEN 1 WHEN p_size < 30 THEN 2 ELSE 3 END AS band
        FROM part""",
    "fn_number": """
        SELECT l_orderkey AS order_key, l_linenumber AS line, l_partkey AS part_key,
               abs(l_linenumber - 4)::INT AS distance,
               round(l_extendedprice::DECIMAL(12,2), 0)::DECIMAL(12,0) AS whole,
               round(l_extendedprice::DECIMAL(12,2) * -1, 1)::DECIMAL(12,1) AS one_place,
               CASE WHEN l_linenumber = 4 THEN NULL ELSE
                 (sign(l_linenumber - 4) * ((l_extendedprice::DECIMAL(12,2) * 100)::BIGINT * 10 * 2 // abs(l_linenumber - 4) + 1) // 2)::BIGINT
                 / 1000.0 END::DECIMAL(12,3) AS per_piece,
               CASE WHEN l_linenumber = 4 THEN NULL ELSE l_partkey % nullif(l_linenumber - 4, 0) END::BIGINT AS rest,
               l_partkey + l_suppkey * 2 - l_linenumber AS sum3
        FROM lineitem""",
    "fn_date": """
        SELECT o_orderkey AS id, o_orderdate::DATE::VARCHAR AS day, strftime(o_orderdate, '%Y/%m') AS month,
               strftime(o_orderdate, '%d.%m.%Y at %H:%M:%S') AS long_form, o_orderdate::DATE::VARCHAR AS parsed,
               NULL::VARCHAR AS bad,
               strftime(try_strptime('2021-3-' || (o_orderkey % 40)::VARCHAR || ' 4:05:06', '%Y-%m-%d %H:%M:%S'), '%Y%m%d%H%M%S') AS moment
        FROM orders""",
    "fn_regex": """
        SELECT doc_id AS id, strlen(regexp_replace(text, '[^0-9]', '', 'g'))::BIGINT AS digits,
               strlen(regexp_replace(text, '[^ ]+', '', 'g'))::BIGINT AS spaces,
               regexp_replace(source, '[aeiou]', '*', 'g') AS source
        FROM documents""",
    "fn_bytes": """
        SELECT doc_id AS id, strlen(text)::BIGINT AS bytes, (strlen(text) - n_chars)::BIGINT AS extra_bytes, lang
        FROM documents""",
    "predicates": """
        SELECT o_orderkey AS id, (o_orderstatus = 'F')::INT AS eq, (o_orderstatus <> 'F')::INT AS ne,
               (o_custkey <> 5)::INT AS ne2, (o_totalprice < 100000)::INT AS lt, (o_orderkey <= o_custkey)::INT AS le,
               (o_totalprice > 100000.5)::INT AS gt, (o_custkey >= 700)::INT AS ge,
               (o_orderstatus = 'O' AND NOT (o_custkey > 500 OR o_custkey < 100))::INT AS "both",
               (o_custkey BETWEEN 100 AND 200)::INT AS between_, (o_orderstatus IN ('F', 'P'))::INT AS in_,
               (o_orderpriority LIKE '_-%H%')::INT AS like_, (nullif(o_orderstatus, 'F') IS NULL)::INT AS null_,
               (nullif(o_orderstatus, 'F') IS NOT NULL)::INT AS not_null,
               (nullif(o_orderstatus, 'F') = 'O')::INT AS unknown, 1 AS yes, 0 AS no
        FROM orders""",
}
