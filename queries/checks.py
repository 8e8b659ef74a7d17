"""Row errors and checks after a load."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.casts import NUMBERS, UUIDS
from queries.common import maps, step, table
from rowferry.operators.checks import (
    compare_checksums, diff_summary, key_check, null_check, recon_checksum, recon_counts, recon_diff, recon_tree)
from rowferry.operators.ledger import METRICS_SCHEMA, execution_report, loadable, row_errors
from rowferry.operators.shape import evaluate
from rowferry.plans.blueprint import stage_step, transformed
from rowferry.sinks.tables import TableStore
from rowferry.workspace import fresh_folder

DIRTY = step("o", maps(
    ("id", "DIRECT", "o.o_orderkey", "BIGINT"), ("amount", "DERIVED", "derivations.amount", "DECIMAL(12,4)"),
    ("uid", "DERIVED", "derivations.uid", "UUID"), ("priority", "DIRECT", "o.o_orderpriority", "VARCHAR(8)")),
    keys=["id"], derivations={"amount": NUMBERS, "uid": UUIDS})


def _evaluated(spark, sf, **checks):
    rows = transformed(DIRTY, {"o": table(spark, sf, "orders")})
    return evaluate(rows, DIRTY.columns, ["id"], **checks)


def error_ledger(spark, sf):
    ledger = row_errors(_evaluated(spark, sf, check_length=True), 1, 3)
    return ledger.select("blueprint_sequence", "batch_number", F.col("row_identity")["id"].alias("identity"),
                         "error_code", "message", "target_column", "raw_value")


def continue_on_error(spark, sf):
    return loadable(_evaluated(spark, sf), reject_bad_rows=True)


def null_on_error(spark, sf):
    return loadable(_evaluated(spark, sf))


def execution_report_query(spark, sf):
    store = TableStore(spark, fresh_folder(spark, "tables"))
    staged, batches = stage_step(spark, DIRTY, {"o": table(spark, sf, "orders")}, store, "orders")
    metrics = spark.createDataFrame([(1, *b) for b in batches], METRICS_SCHEMA)
    report = execution_report("mig_1", metrics, row_errors(staged, 1), steps=1)
    return report.drop("error_counts", "message")


def key_check_query(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.nullif("l_linenumber", F.lit(7)).alias("line"))
    return key_check(lines, ["l_orderkey", "line"])


def null_check_query(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"),
        F.expr("CASE WHEN o_totalprice > 100000 THEN o_custkey END").alias("customer"),
        F.try_to_date("o_orderpriority", "yyyy-M-d").alias("day"))
    return null_check(orders, ["o_orderkey", "status", "customer", "day"])


def recon_counts_query(spark, sf):
    lines = table(spark, sf, "lineitem")
    flag = lambda *f: lines.filter(F.col("l_returnflag").isin(*f))
    return recon_counts(lines, flag("A", "N"), flag("R"))


def _orders(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(12,2)").alias("price"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))


COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "price", "priority"]


def recon_checksum_query(spark, sf):
    return recon_checksum(_orders(spark, sf), COLUMNS, F.pmod("o_custkey", F.lit(16)))


def _altered(spark, sf):
    """The orders as a flawed load left them: some missing, some changed, some that are new."""
    orders = _orders(spark, sf)
    kept = orders.filter("not (o_orderstatus = 'P' and price > 400000)")
    changed = kept.withColumns({
        "price": F.expr("CASE WHEN priority = '1-URGENT' THEN cast(price + 1 as decimal(12,2)) ELSE price END"),
        "priority": F.expr("CASE WHEN o_orderstatus = 'F' THEN NULL ELSE priority END")})
    return changed.unionByName(orders.filter("priority is null").withColumn("o_orderkey", -F.col("o_orderkey") - 1))


def recon_checksum_differs(spark, sf):
    bucket = F.pmod("o_custkey", F.lit(64))
    found = compare_checksums(recon_checksum(_orders(spark, sf), COLUMNS, bucket),
                              recon_checksum(_altered(spark, sf), COLUMNS, bucket))
    return found.select("bucket", "source_rows", "target_rows")


def recon_diff_query(spark, sf):
    return recon_diff(_orders(spark, sf), _altered(spark, sf), ["o_orderkey"], COLUMNS[1:])


def recon_tree_query(spark, sf):
    """The same differences, by checksum trees and the rows of differing leaves."""
    return recon_tree(_orders(spark, sf), _altered(spark, sf), ["o_orderkey"], COLUMNS[1:])


def recon_diff_multi(spark, sf):
    """Keys with several rows on both sides, against a copy without the returned lines."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return recon_diff(lines, lines.filter("l_returnflag <> 'R'"), ["l_orderkey", "l_linenumber"],
                      ["l_partkey", "l_returnflag"])


def recon_summary(spark, sf):
    return diff_summary(recon_diff_query(spark, sf))


QUERIES = {
    "error_ledger": error_ledger, "continue_on_error": continue_on_error, "null_on_error": null_on_error,
    "execution_report": execution_report_query, "key_check": key_check_query, "null_check": null_check_query,
    "recon_counts": recon_counts_query, "recon_checksum": recon_checksum_query,
    "recon_checksum_differs": recon_checksum_differs, "recon_diff": recon_diff_query,
    "recon_tree": recon_tree_query, "recon_diff_multi": recon_diff_multi, "recon_summary": recon_summary,
}

_NUMBER = r"regexp_full_match(n, '-?[0-9]+(\.[0-9]+)?')"
_UUID = "regexp_full_match(u, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}')"
_EVALUATED = f"""
    WITH raw AS (SELECT o_orderkey AS id, {NUMBERS} AS amount_raw, {UUIDS} AS uid_raw, o_orderpriority AS priority FROM orders),
    trimmed AS (SELECT *, nullif(trim(amount_raw), '') AS n, nullif(trim(uid_raw), '') AS u FROM raw),
    evaluated AS (SELECT *, CASE WHEN {_NUMBER} THEN try_cast(n AS DECIMAL(12,4)) END AS amount,
                         CASE WHEN {_UUID} THEN u END AS uid FROM trimmed)
"""
_ERRORS = f"""{_EVALUATED}, errors AS (
    SELECT id, 'CAST_FAILED' AS error_code, 'Invalid DECIMAL' AS message, 'amount' AS target_column, amount_raw AS raw_value
      FROM evaluated WHERE n IS NOT NULL AND amount IS NULL
    UNION ALL SELECT id, 'CAST_FAILED', 'Invalid UUID', 'uid', uid_raw FROM evaluated WHERE u IS NOT NULL AND uid IS NULL
    UNION ALL SELECT id, 'TOO_LONG', 'Longer than 8 characters', 'priority', priority FROM evaluated WHERE length(priority) > 8)
"""
_ORDERS = """
    WITH s AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice::DECIMAL(12,2) AS price,
                      nullif(o_orderpriority, '5-LOW') AS priority FROM orders),
    t AS (SELECT o_orderkey, o_custkey, o_orderstatus,
                 CASE WHEN priority = '1-URGENT' THEN (price + 1)::DECIMAL(12,2) ELSE price END AS price,
                 CASE WHEN o_orderstatus = 'F' THEN NULL ELSE priority END AS priority
          FROM s WHERE NOT (o_orderstatus = 'P' AND price > 400000)
          UNION ALL SELECT -o_orderkey - 1, o_custkey, o_orderstatus, price, priority FROM s WHERE priority IS NULL)
"""
_TEXT = " || ".join(f"coalesce(length({c})::VARCHAR || chr(31) || {c}, '\\N')" for c in (
    "o_orderkey::VARCHAR", "o_custkey::VARCHAR", "o_orderstatus", "price::VARCHAR", "priority"))
_CHECKSUM = """
    SELECT (o_custkey % {n})::BIGINT AS bucket, count(*)::BIGINT AS rows,
           sum(('0x' || substr(md5({text}), 1, 15))::BIGINT::HUGEINT)::DECIMAL(38,0) AS checksum
    FROM {t} GROUP BY 1"""
_DIFF = f"""{_ORDERS}, diff AS (
    SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey,
           CASE WHEN t.o_orderkey IS NULL THEN 'MISSING' WHEN s.o_orderkey IS NULL THEN 'EXTRA'
                WHEN s.price <> t.price OR s.priority IS DISTINCT FROM t.priority THEN 'DIFFERENT' END AS status,
           (s.o_orderkey IS NOT NULL)::BIGINT AS source_rows, (t.o_orderkey IS NOT NULL)::BIGINT AS target_rows,
           CASE WHEN s.o_orderkey IS NOT NULL AND t.o_orderkey IS NOT NULL THEN
             concat_ws(',', CASE WHEN s.price <> t.price THEN 'price' END,
                       CASE WHEN s.priority IS DISTINCT FROM t.priority THEN 'priority' END) END AS columns
    FROM s FULL JOIN t ON s.o_orderkey = t.o_orderkey)
"""

ORACLE = {
    "error_ledger": f"""{_ERRORS} SELECT 1 AS blueprint_sequence, 3::BIGINT AS batch_number, id::VARCHAR AS identity,
        error_code, message, target_column, raw_value FROM errors""",
    "continue_on_error": f"""{_ERRORS} SELECT id, amount, uid, priority FROM evaluated
        WHERE id NOT IN (SELECT id FROM errors WHERE error_code = 'CAST_FAILED')""",
    "null_on_error": f"{_EVALUATED} SELECT id, amount, uid, priority FROM evaluated",
    "execution_report": f"""{_ERRORS} SELECT 'mig_1' AS migration_id, TRUE AS success, 1::BIGINT AS blueprints_completed,
        (SELECT count(*) FROM orders)::BIGINT AS rows_processed, 1::BIGINT AS batches_processed,
        (SELECT count(*) FROM errors WHERE error_code = 'CAST_FAILED')::BIGINT AS row_error_count""",
    "key_check": """
        SELECT l_orderkey, nullif(l_linenumber, 7) AS line, count(*)::BIGINT AS rows,
               CASE WHEN nullif(l_linenumber, 7) IS NULL THEN 'NULL_KEY' ELSE 'DUPLICATE_KEY' END AS problem
        FROM lineitem GROUP BY 1, 2 HAVING nullif(l_linenumber, 7) IS NULL OR count(*) > 1""",
    "null_check": """
        SELECT 'o_orderkey' AS column_name, 0::BIGINT AS null_rows, count(*)::BIGINT AS total_rows FROM orders
        UNION ALL SELECT 'status', (count(*) FILTER (WHERE o_orderstatus = 'F'))::BIGINT, count(*)::BIGINT FROM orders
        UNION ALL SELECT 'customer', (count(*) FILTER (WHERE o_totalprice <= 100000))::BIGINT, count(*)::BIGINT FROM orders
        UNION ALL SELECT 'day', count(*)::BIGINT, count(*)::BIGINT FROM orders""",
    "recon_counts": """
        SELECT count(*)::BIGINT AS source_rows, (count(*) FILTER (WHERE l_returnflag IN ('A', 'N')))::BIGINT AS loaded_rows,
               (count(*) FILTER (WHERE l_returnflag = 'R'))::BIGINT AS rejected_rows, 0::BIGINT AS difference, TRUE AS balanced
        FROM lineitem""",
    "recon_checksum": _ORDERS + _CHECKSUM.format(text=_TEXT, n=16, t="s"),
    "recon_checksum_differs": f"""{_ORDERS}, a AS ({_CHECKSUM.format(text=_TEXT, n=64, t='s')}), b AS ({_CHECKSUM.format(text=_TEXT, n=64, t='t')})
        SELECT coalesce(a.bucket, b.bucket) AS bucket, a.rows AS source_rows, b.rows AS target_rows
        FROM a FULL JOIN b ON a.bucket = b.bucket WHERE a.checksum IS DISTINCT FROM b.checksum""",
    "recon_diff": f"{_DIFF} SELECT * FROM diff WHERE status IS NOT NULL",
    "recon_summary": f"{_DIFF} SELECT status, count(*)::BIGINT AS keys FROM diff WHERE status IS NOT NULL GROUP BY 1",
    "recon_tree": f"{_DIFF} SELECT * FROM diff WHERE status IS NOT NULL",
    "recon_diff_multi": """
        SELECT l_orderkey, l_linenumber, CASE WHEN kept = 0 THEN 'MISSING' ELSE 'DIFFERENT' END AS status,
               source_rows, kept AS target_rows, CASE WHEN kept > 0 THEN 'l_partkey,l_returnflag' END AS columns
        FROM (SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS source_rows,
                     (count(*) FILTER (WHERE l_returnflag <> 'R'))::BIGINT AS kept
              FROM lineitem GROUP BY 1, 2) WHERE kept < source_rows""",
}
