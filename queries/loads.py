"""Conflict policies: lineitem as a batch with many rows per key, loaded into a part-filled target."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import Interrupted, maps, step, table
from rowferry.operators import conflict
from rowferry.plans.blueprint import load_step, stage_step
from rowferry.plans.migration import run_migration
from rowferry.sinks.audit import audit_layout, audit_rows
from rowferry.sinks.tables import StaleTable, TableStore
from rowferry.spec import Connection, Migration, Target
from rowferry.workspace import fresh_folder

KEYS = ["l_orderkey", "l_linenumber"]
BATCH = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price"]


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        *BATCH[:4], F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
        F.col("l_shipdate").cast("date").alias("shipped"), "l_returnflag")


def batch(spark, sf):
    return _lines(spark, sf).select(*BATCH, "shipped")


def target(spark, sf):
    """What an earlier load left: the keys with a returned line, with older values."""
    return (_lines(spark, sf).filter("l_returnflag = 'R'").groupBy(*KEYS)
            .agg(F.max("l_partkey").alias("l_partkey"), F.lit(0).cast("bigint").alias("l_suppkey"),
                 F.min("price").alias("price")))


def load_ignore(spark, sf):
    return conflict.ignore(target(spark, sf), batch(spark, sf), KEYS, ["shipped"]).new_target


def load_upsert(spark, sf):
    return conflict.upsert(target(spark, sf), batch(spark, sf), KEYS, ["shipped"]).new_target


def load_upsert_partial(spark, sf):
    """The batch lacks l_partkey and l_suppkey: existing rows keep theirs, new rows get NULL."""
    rows = batch(spark, sf).select(*KEYS, "price", "shipped")
    return conflict.upsert(target(spark, sf), rows, KEYS, ["shipped"]).new_target


def load_upsert_keys_only(spark, sf):
    """Only key columns are mapped: existing rows stay as they are."""
    return conflict.upsert(target(spark, sf), batch(spark, sf).select(*KEYS), KEYS).new_target


def load_ignore_log(spark, sf):
    load = conflict.ignore_and_capture(target(spark, sf), batch(spark, sf).select(*BATCH), KEYS)
    return (load.new_target.withColumn("goes_to", F.lit("target"))
            .unionByName(load.rejects.drop("reject_reason").withColumn("goes_to", F.lit("log"))))


def load_batch_duplicates(spark, sf):
    load = conflict.ignore_and_capture(target(spark, sf), batch(spark, sf).select(*BATCH), KEYS,
                                       log_batch_duplicates=True)
    return load.rejects


def load_fail_clean(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    load = conflict.fail(orders.filter("o_orderstatus = 'P'"), orders.filter("o_orderstatus <> 'P'"), ["o_orderkey"])
    conflict.require_no_conflicts(load)
    return load.new_target


def load_fail_conflicts(spark, sf):
    return conflict.fail(target(spark, sf), batch(spark, sf).select(*BATCH), KEYS).conflicts


LINE_COLUMNS = maps(
    ("l_orderkey", "DIRECT", "l.l_orderkey", "BIGINT"), ("l_linenumber", "DIRECT", "l.l_linenumber", "INT"),
    ("l_partkey", "DIRECT", "l.l_partkey", "BIGINT"), ("l_suppkey", "DIRECT", "l.l_suppkey", "BIGINT"),
    ("price", "DIRECT", "l.l_extendedprice", "DECIMAL(12,2)"))


def load_unprocessed(spark, sf):
    """The whole path: staged, loaded under the policy, conflicting rows in their own table."""
    store = TableStore(spark, fresh_folder(spark, "tables"))
    store.publish("migrated", "lines", target(spark, sf))
    s = step("l", LINE_COLUMNS, keys=KEYS)
    s = _with_target(s, Target("migrated", "lines", tuple(KEYS), "IGNORE_AND_INSERT_UNPROCESSED", "lines_unprocessed"))
    staged, _ = stage_step(spark, s, {"l": table(spark, sf, "lineitem")}, store, "lines")
    load_step(spark, s, staged, store)
    done = store.read("migrated", "lines").withColumn("goes_to", F.lit("target"))
    left = store.read("migrated", "lines_unprocessed").drop("rejected_at").withColumn("goes_to", F.lit("unprocessed"))
    return done.unionByName(left)


ORDER_COLUMNS = maps(("order_key", "DIRECT", "o.o_orderkey", "BIGINT"), ("status", "DIRECT", "o.o_orderstatus", "TEXT"),
                     ("price", "DIRECT", "o.o_totalprice", "DECIMAL(12,2)"))


def load_upsert_bucketed(spark, sf):
    """A target in 32 buckets of its key: loaded, then a few keys of it and a few new ones, then new ones only."""
    store, orders = TableStore(spark, fresh_folder(spark, "tables")), table(spark, sf, "orders")
    s = _with_target(step("o", ORDER_COLUMNS, keys=["order_key"]), Target("migrated", "orders", ("order_key",), "UPSERT", buckets=32))
    loads = orders.filter("o_orderstatus <> 'P'").withColumn("o_totalprice", F.lit(0)), orders.filter("o_orderkey < 40"), orders.filter(
        "o_orderstatus = 'P' AND o_orderkey >= 40")
    for number, rows in enumerate(loads):
        staged, _ = stage_step(spark, s, {"o": rows}, store, f"load{number}")
        load_step(spark, s, staged, store)
    return store.read("migrated", "orders")


NAME_COLUMNS = maps(("name", "DIRECT", "c.name", "TEXT"), ("id", "DIRECT", "c.c_custkey", "BIGINT"), ("version", "DIRECT", "c.version", "INT"))


def _loaded_nocase(spark, sf, policy):
    """A target keyed by names in lower case; then all customers, each as it is and in upper case, through a
    target connection that compares text without case."""
    store = TableStore(spark, fresh_folder(spark, "tables"))
    customers = table(spark, sf, "customer").withColumns({"name": F.col("c_name"), "version": F.lit(1)})
    first = customers.filter("c_acctbal >= 0").withColumns({"name": F.lower("c_name"), "version": F.lit(0)})
    both = customers.unionByName(customers.withColumns({"name": F.upper("c_name"), "version": F.lit(2)}))
    names = Target("migrated", "names", ("name",), policy, connection="lake", order_by=("version",))
    lake = {"data": Connection("PARQUET", sf), "lake": Connection("PARQUET", sf, {"collation": "UTF8_LCASE"})}
    for run, rows in (("first", first), ("both", both)):
        s = _with_target(step("c", NAME_COLUMNS, keys=["name"]), names)
        run_migration(spark, Migration("m", "c", "1", lake, (s,)), store, run_id=run, sources=lambda _, rows=rows: {"c": rows})
    return store


def load_upsert_nocase(spark, sf):
    return _loaded_nocase(spark, sf, "UPSERT").read("migrated", "names")


def load_log_nocase(spark, sf):
    store = _loaded_nocase(spark, sf, "IGNORE_AND_LOG")
    log = store.read("migrated", "migration_conflict_log").select("name", "id", "version").withColumn("goes_to", F.lit("log"))
    return store.read("migrated", "names").withColumn("goes_to", F.lit("target")).unionByName(log)


def load_log_after_stale(spark, sf):
    """Another load adds keys while ours is written, so ours is withdrawn and done again under its tag: the
    log has the rows that meet either's keys, once."""
    orders = table(spark, sf, "orders")
    rows = orders.select(F.col("o_orderkey").alias("order_key"), F.col("o_orderstatus").alias("status"),
                         F.col("o_totalprice").cast("decimal(12,2)").alias("price"))
    root, seen = fresh_folder(spark, "tables"), []

    def intrude(schema, name):
        if (schema, name) == ("migrated", "orders") and not seen:
            seen.append(name)
            TableStore(spark, root).publish(schema, name, rows.filter("status = 'O'"), mode="add")

    plain, store = TableStore(spark, root), Interrupted(spark, root, intrude)
    plain.publish("migrated", "orders", rows.filter("status = 'F'"))
    s = _with_target(step("o", ORDER_COLUMNS, keys=["order_key"]), Target("migrated", "orders", ("order_key",), "IGNORE_AND_LOG"))
    staged, _ = stage_step(spark, s, {"o": orders}, store, "orders")
    refused = 0
    for _ in range(2):
        try:
            load_step(spark, s, staged, store, tag="run")
        except StaleTable:
            refused += 1
    logged = store.read("migrated", "migration_conflict_log").select("order_key", "status", "reject_reason")
    return logged.withColumns({"withdrawn": F.lit(refused), "target_rows": F.lit(store.read("migrated", "orders").count()).cast("bigint")})


def _with_target(s, t):
    from dataclasses import replace
    return replace(s, target=t)


def audit_rows_query(spark, sf):
    t = Target("billing", "lines", tuple(KEYS), "IGNORE_AND_LOG")
    rejects = conflict.captured(target(spark, sf), batch(spark, sf).select(*BATCH[:4]), KEYS)
    rows = audit_rows(rejects, BATCH[:4], "mig_1", 2, t)
    layout = audit_layout(rejects.select(*BATCH[:4]).schema, KEYS)
    return rows.select(*[c for c in layout.names if c not in ("rejected_at", "logged_at")])


def append_sources(spark, sf):
    """Three sources of one target: orders by status; the line totals; customers' latest order."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("decimal(14,2)").alias("amount"), F.lit("order").alias("origin"))
    lines = (table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"))
             .agg(F.sum(F.col("l_extendedprice").cast("decimal(14,2)")).cast("decimal(14,2)").alias("amount"))
             .withColumn("origin", F.lit("lines")))
    latest = (table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("id"))
              .select("id", F.lit(None).cast("decimal(14,2)").alias("amount"), F.lit("latest").alias("origin")))
    return conflict.append_sources([orders, lines, latest], ["id"])


QUERIES = {
    "load_ignore": load_ignore, "load_upsert": load_upsert, "load_upsert_partial": load_upsert_partial,
    "load_upsert_keys_only": load_upsert_keys_only, "load_ignore_log": load_ignore_log,
    "load_upsert_bucketed": load_upsert_bucketed, "load_log_after_stale": load_log_after_stale,
    "load_upsert_nocase": load_upsert_nocase, "load_log_nocase": load_log_nocase,
    "load_batch_duplicates": load_batch_duplicates, "load_fail_clean": load_fail_clean,
    "load_fail_conflicts": load_fail_conflicts, "load_unprocessed": load_unprocessed,
    "audit_rows": audit_rows_query, "append_sources": append_sources,
}

_WITH = """
    WITH lines AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice::DECIMAL(12,2) AS price,
                          l_shipdate::DATE AS shipped, l_returnflag FROM lineitem),
    target AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, 0::BIGINT AS l_suppkey, min(price) AS price
               FROM lines WHERE l_returnflag = 'R' GROUP BY 1, 2),
    last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
               ORDER BY shipped DESC, l_partkey DESC, l_suppkey DESC, price DESC) AS n FROM lines) WHERE n = 1),
    first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
               ORDER BY shipped, l_partkey, l_suppkey, price) AS n FROM lines) WHERE n = 1),
    least_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
               ORDER BY l_partkey, l_suppkey, price) AS n FROM lines) WHERE n = 1),
    last_price AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
               ORDER BY shipped DESC, price DESC) AS n FROM lines) WHERE n = 1)
"""
_NEW = "(l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM target)"
_OLD = "(l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM target)"
_COLUMNS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, price"

ORACLE = {
    "load_upsert_nocase": """
        SELECT CASE WHEN c_acctbal >= 0 THEN lower(c_name) ELSE upper(c_name) END AS name, c_custkey AS id, 2 AS version FROM customer""",
    "load_log_nocase": """
        SELECT CASE WHEN c_acctbal >= 0 THEN lower(c_name) ELSE c_name END AS name, c_custkey AS id,
               CASE WHEN c_acctbal >= 0 THEN 0 ELSE 1 END AS version, 'target' AS goes_to FROM customer
        UNION ALL SELECT c_name, c_custkey, 1, 'log' FROM customer WHERE c_acctbal >= 0
        UNION ALL SELECT upper(c_name), c_custkey, 2, 'log' FROM customer WHERE c_acctbal >= 0""",
    "load_upsert_bucketed": """
        SELECT o_orderkey AS order_key, o_orderstatus AS status,
               (CASE WHEN o_orderkey < 40 OR o_orderstatus = 'P' THEN o_totalprice ELSE 0 END)::DECIMAL(12,2) AS price FROM orders""",
    "load_log_after_stale": """
        SELECT o_orderkey AS order_key, o_orderstatus AS status, 'DUPLICATE_KEY' AS reject_reason, 1 AS withdrawn,
               (SELECT count(*) FROM orders)::BIGINT AS target_rows FROM orders WHERE o_orderstatus <> 'P'""",
    "load_ignore": f"{_WITH} SELECT * FROM target UNION ALL SELECT {_COLUMNS} FROM first WHERE {_NEW}",
    "load_upsert": f"""{_WITH} SELECT {_COLUMNS} FROM last
        UNION ALL SELECT * FROM target WHERE (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM lines)""",
    "load_upsert_partial": f"""{_WITH}
        SELECT b.l_orderkey, b.l_linenumber, t.l_partkey, t.l_suppkey, b.price
        FROM last_price b LEFT JOIN target t ON t.l_orderkey = b.l_orderkey AND t.l_linenumber = b.l_linenumber""",
    "load_upsert_keys_only": f"""{_WITH} SELECT * FROM target UNION ALL
        SELECT DISTINCT l_orderkey, l_linenumber, NULL::BIGINT, NULL::BIGINT, NULL::DECIMAL(12,2) FROM lines WHERE {_NEW}""",
    "load_ignore_log": f"""{_WITH} SELECT *, 'target' AS goes_to FROM target
        UNION ALL SELECT {_COLUMNS}, 'target' FROM least_ WHERE {_NEW}
        UNION ALL SELECT {_COLUMNS}, 'log' FROM lines WHERE {_OLD}""",
    "load_batch_duplicates": f"""{_WITH}
        SELECT {_COLUMNS}, 'DUPLICATE_KEY' AS reject_reason, 1::BIGINT AS copies FROM lines WHERE {_OLD}
        UNION ALL
        SELECT {_COLUMNS}, 'DUPLICATE_IN_BATCH', copies FROM (
          SELECT {_COLUMNS}, (count(*) FILTER (WHERE n > 1))::BIGINT AS copies FROM (
            SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, price) AS n
            FROM lines) WHERE {_NEW} GROUP BY ALL) WHERE copies > 0""",
    "load_fail_clean": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
    "load_fail_conflicts": f"""{_WITH}
        SELECT *, CASE WHEN in_target THEN 'DUPLICATE_KEY' ELSE 'DUPLICATE_IN_BATCH' END AS reject_reason FROM (
          SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS batch_rows, bool_or({_OLD}) AS in_target
          FROM lines GROUP BY 1, 2) WHERE in_target OR batch_rows > 1""",
    "load_unprocessed": f"""{_WITH} SELECT *, 'target' AS goes_to FROM target
        UNION ALL SELECT {_COLUMNS}, 'target' FROM least_ WHERE {_NEW}
        UNION ALL SELECT {_COLUMNS}, 'unprocessed' FROM lines WHERE {_OLD}""",
    "audit_rows": f"""{_WITH}
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'mig_1' AS migration_id, 2 AS blueprint_sequence,
               'billing' AS target_schema, 'lines' AS target_table,
               '{{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || '}}' AS source_snapshot,
               'DUPLICATE_KEY' AS reject_reason,
               '{{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey
                 || ',"l_suppkey":' || l_suppkey || '}}' AS raw_row
        FROM lines WHERE {_OLD}""",
    "append_sources": """
        WITH every AS (
          SELECT 1 AS s, o_orderkey AS id, o_totalprice::DECIMAL(14,2) AS amount, 'order' AS origin FROM orders
          UNION ALL SELECT 2, l_orderkey, sum(l_extendedprice::DECIMAL(14,2))::DECIMAL(14,2), 'lines' FROM lineitem GROUP BY l_orderkey
          UNION ALL SELECT 3, max(o_orderkey), NULL, 'latest' FROM orders GROUP BY o_custkey)
        SELECT id, amount, origin FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC) AS n FROM every) WHERE n = 1""",
}
