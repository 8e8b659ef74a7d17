"""Whole steps and migrations: staged, loaded, logged and run again."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from queries.common import Died, Interrupted, join, maps, run, step, table
from rowferry.operators.chunks import chunk_bounds, even_ends, load_ranges, part_number
from rowferry.operators.ledger import rows_per_batch
from rowferry.plans.blueprint import load_step, stage_step
from rowferry.plans.migration import run_migration
from rowferry.sinks.tables import TableStore
from rowferry.spec import Chunking, Target, migration_from
from rowferry.streaming.batches import file_stream, row_stream, run_stream, stage_row_batches, stage_stream, stream_metrics
from rowferry.workspace import fresh_folder


def _store(spark):
    return TableStore(spark, fresh_folder(spark, "tables"))


ACCOUNTS = step("cu", maps(
    ("account", "DIRECT", "cu.c_custkey", "BIGINT"),
    ("label", "DERIVED", "derivations.label", "VARCHAR(64)"),
    ("nation", "EXPRESSION", "IFNULL(na.n_name, 'abroad')", "VARCHAR(32)"),
    ("origin", "CONSTANT", "'TESTDATA'", "VARCHAR(16)")),
    keys=["account"], policy="UPSERT",
    joins=[join("na", "LEFT", ("na.n_nationkey", "=", "cu.c_nationkey"), ("na.n_regionkey", "<", "4"))],
    pre_filters=["cu.c_acctbal > 0"],
    derivations={"label": "LOWER(CONCAT('Account/', cu.c_name))"},
    post_filters=["label <> 'account/'"])


def run_blueprint_query(spark, sf):
    return run(ACCOUNTS, cu=table(spark, sf, "customer"), na=table(spark, sf, "nation"))


# A migration of three steps as a configuration document -----------------------------------------

def _mapping(column, kind, value, to, nullable=False):
    return {"target_column": column, "source_type": kind, "source_value": value, "cast_to": to, "is_nullable": nullable}


def _on(left, right):
    return [{"left_expression": left, "operator": "=", "right_expression": right}]


def _step(order, target, root, joins, mappings, *, chunk=None, pre=(), derived=None):
    return {
        "sequence_order": order, "target": {"connection_ref": "lake", "on_conflict": "UPSERT", **target},
        "sources": {"root_table": root, "joins": joins},
        "chunking_strategy": {"is_enabled": bool(chunk), "chunk_by_column": chunk and chunk[0], "chunk_size": chunk and chunk[1]},
        "pre_filters": list(pre), "post_filters": [], "mappings": mappings,
        "derivations": [{"variable_name": k, "expression": v} for k, v in (derived or {}).items()]}


def _lake(name, alias):
    return {"connection_ref": "lake", "schema": "tpch", "table_name": name, "alias": alias}


def _file(name, alias):
    return {"connection_ref": "archive", "file_name": name, "alias": alias}


def document(sf: str, archive: str) -> dict:
    """Accounts with their nation, the lines shipped since 1997, and older lines from paper lists."""
    lines = {"schema": "shipping", "table_name": "lines", "primary_keys": ["order_key", "line_no"]}
    accounts = _step(
        1, {"schema": "directory", "table_name": "accounts", "primary_keys": ["account"]}, _lake("customer", "cu"),
        [{"join_type": "INNER", **_lake("nation", "na"), "conditions": _on("na.n_nationkey", "cu.c_nationkey")}],
        [_mapping("account", "DIRECT", "cu.c_custkey", "BIGINT"), _mapping("label", "DIRECT", "cu.c_name", "VARCHAR(64)"),
         _mapping("in_credit", "EXPRESSION", "IF(cu.c_acctbal >= 0, 1, 0)", "INT"),
         _mapping("nation", "DIRECT", "na.n_name", "VARCHAR(32)")],
        pre=["cu.c_acctbal > -500"])
    shipped = _step(
        2, lines, _lake("lineitem", "ln"),
        [{"join_type": "INNER", **_lake("orders", "od"), "conditions": _on("od.o_orderkey", "ln.l_orderkey")},
         {"join_type": "LEFT", **_lake("part", "pt"), "conditions": _on("pt.p_partkey", "ln.l_partkey")}],
        [_mapping("order_key", "DIRECT", "od.o_orderkey", "BIGINT"), _mapping("line_no", "DIRECT", "ln.l_linenumber", "INT"),
         _mapping("part_name", "DIRECT", "pt.p_name", "TEXT", True),
         _mapping("net", "DERIVED", "derivations.net", "DECIMAL(14,2)", True),
         _mapping("shipped", "DIRECT", "ln.l_shipdate", "DATE"), _mapping("origin", "CONSTANT", "'LIVE'", "VARCHAR(8)")],
        chunk=("ln.l_orderkey", 2500), pre=["ln.l_shipdate >= '1997-01-01'"],
        derived={"net": "CAST(ln.l_extendedprice AS DECIMAL(12,2)) - ln.l_linenumber"})
    paper = _step(
        3, lines, _file("items.csv", "it"),
        [{"join_type": "INNER", **_file("heads.csv", "hd"), "conditions": _on("hd.ref", "it.order_ref")}],
        [_mapping("order_key", "EXPRESSION", "-1 - CAST(hd.ref AS SIGNED)", "BIGINT"),
         _mapping("line_no", "DIRECT", "it.position", "INT"),
         _mapping("part_name", "EXPRESSION", "CONCAT('part ', it.part_ref)", "TEXT", True),
         _mapping("net", "DIRECT", "it.amount", "DECIMAL(14,2)", True),
         _mapping("shipped", "DIRECT", "it.sent", "DATE"), _mapping("origin", "CONSTANT", "'PAPER'", "VARCHAR(8)")])
    return {
        "migration_id": "mig_lines", "client_id": "client_1", "version": "1.0.0",
        "connections": {
            "lake": {"type": "PARQUET", "path": sf},
            "archive": {"type": "CSV_S3_BUCKET", "s3_bucket_uri": f"{archive}/", "aws_region": "us-west-2"}},
        "blueprints": [accounts, shipped, paper]}


def _archive(spark, sf):
    """The lines shipped before 1997 as CSV files, those of returned goods with a dirty amount."""
    folder = fresh_folder(spark, "csv")
    table(spark, sf, "orders").select(F.col("o_orderkey").alias("ref")).write.option("header", True).csv(f"{folder}/heads.csv")
    (table(spark, sf, "lineitem").filter("l_shipdate < '1997-01-01'").select(
        F.col("l_orderkey").alias("order_ref"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("part_ref"),
        F.expr("CASE WHEN l_returnflag = 'R' THEN 'n/a' ELSE concat('', cast(l_extendedprice AS decimal(12,2))) END").alias("amount"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("sent")).write.option("header", True).csv(f"{folder}/items.csv"))
    return folder


def _migrated(spark, sf, **options):
    store = _store(spark)
    migration = migration_from(document(sf, _archive(spark, sf)))
    return store, migration, run_migration(spark, migration, store, run_id="first", **options)


def _lines(store):
    rows = store.read("shipping", "lines")
    return rows.withColumn("shipped", F.col("shipped").cast("string"))


def run_migration_query(spark, sf):
    return _lines(_migrated(spark, sf)[0])


def migration_customers(spark, sf):
    return _migrated(spark, sf)[0].read("directory", "accounts")


def migration_rerun(spark, sf):
    """The whole migration run a second time onto its own result."""
    store, migration, _ = _migrated(spark, sf)
    run_migration(spark, migration, store, run_id="second")
    return _lines(store)


def migration_report(spark, sf):
    return _migrated(spark, sf)[2].report.drop("error_counts")


# Chunked loads ---------------------------------------------------------------------------------

ORDERS = replace(step("o", maps(
    ("order_key", "DIRECT", "o.o_orderkey", "BIGINT"), ("status", "DIRECT", "o.o_orderstatus", "CHAR(1)"),
    ("price", "DIRECT", "o.o_totalprice", "DECIMAL(12,2)")), keys=["order_key"], policy="UPSERT"),
    chunking=Chunking("o.o_orderkey", 2500))


def chunked_load(spark, sf):
    """One job; the chunk is a column of the staged rows."""
    store = _store(spark)
    staged, _ = stage_step(spark, ORDERS, {"o": table(spark, sf, "orders")}, store, "orders")
    load_step(spark, ORDERS, staged, store)
    chunks = staged.select("order_key", F.col("_batch").alias("chunk"))
    return store.read("migrated", "result").join(chunks, "order_key")


def chunk_metrics(spark, sf):
    store = _store(spark)
    staged, _ = stage_step(spark, ORDERS, {"o": table(spark, sf, "orders")}, store, "orders")
    return rows_per_batch(staged, 1)


def chunked_resume(spark, sf):
    """Ranges of chunks staged one after the other, then all again: what is there is skipped."""
    store, orders = _store(spark), table(spark, sf, "orders")
    for _ in range(2):
        staged, _ = stage_step(spark, ORDERS, {"o": orders}, store, "orders", commits=3, tag="run-")
    load_step(spark, ORDERS, staged, store, tag="run")
    return store.read("migrated", "result")


def _staged_in_ranges(spark, orders):
    store = _store(spark)
    staged, _ = stage_step(spark, ORDERS, {"o": orders}, store, "orders", commits=4, tag="run-")
    load_step(spark, ORDERS, staged, store, tag="run")
    return store.read("migrated", "result")


def chunked_commits_text_key(spark, sf):
    """Ranges over keys that are text, as those of CSV files are."""
    return _staged_in_ranges(spark, table(spark, sf, "orders").withColumn("o_orderkey", F.col("o_orderkey").cast("string")))


def chunked_commits_decimal_key(spark, sf):
    """Ranges over keys with fractions, the greatest key among them; rounded when loaded."""
    key = (F.col("o_orderkey") + F.lit(0.25)).cast("decimal(12,2)")
    s = replace(ORDERS, columns=(replace(ORDERS.columns[0], value="o.o_custkey"), *ORDERS.columns[1:]),
                target=replace(ORDERS.target, policy="FAIL", keys=()))
    store = _store(spark)
    staged, _ = stage_step(spark, s, {"o": table(spark, sf, "orders").withColumn("o_orderkey", key)}, store, "orders",
                           commits=4, tag="run-")
    load_step(spark, s, staged, store, tag="run")
    return store.read("migrated", "result")


def _resumed(spark, first, then, commits, parts):
    """A run that dies when it has staged some parts, and goes on under its name and tag with other rows and
    another number of commits."""
    left = [parts]

    def die(schema, name):
        if (schema, name) == ("staging", "orders"):
            left[0] -= 1
            if left[0] < 0:
                raise Died

    root = fresh_folder(spark, "tables")
    store = TableStore(spark, root)
    try:
        stage_step(spark, ORDERS, {"o": first}, Interrupted(spark, root, die), "orders", commits=commits[0], tag="run-")
    except Died:
        pass
    before = {v.path for v in store.versions("staging", "orders")}
    staged, _ = stage_step(spark, ORDERS, {"o": then}, store, "orders", commits=commits[1], tag="run-")
    kept = len(before & {v.path for v in store.versions("staging", "orders")})
    load_step(spark, ORDERS, staged, store, tag="run")
    return store.read("migrated", "result").withColumns({
        "found": F.lit(len(before)), "kept": F.lit(kept)})


def chunked_resume_grown(spark, sf):
    """The first run had only the keys below 5000; the ranges it drew and the two parts it staged are kept."""
    orders = table(spark, sf, "orders")
    return _resumed(spark, orders.filter("o_orderkey < 5000"), orders, (2, 3), 1)


def chunked_resume_late(spark, sf):
    """Keys that come late in the first of two parts that the first run had finished: it is staged again."""
    orders = table(spark, sf, "orders")
    low = orders.agg(F.min("o_orderkey")).first()[0]
    return _resumed(spark, orders.filter(f"o_orderkey < {low + 10} OR o_orderkey >= {low + 30}"), orders, (4, 4), 2)


def chunk_plan_even(spark, sf):
    """Eight ranges of a key that is dense at its low end: their rows, and whether none has over 1.5 times the mean."""
    lines = table(spark, sf, "lineitem").select(F.expr("l_partkey * l_partkey * l_partkey").alias("key"))
    lo, hi = chunk_bounds(lines, "key").first()
    ranges = load_ranges(lo, hi, 1, 8, even_ends(lines, "key", 8))
    counts = lines.groupBy(part_number(F.col("key"), ranges).alias("part")).count()
    return counts.agg(F.count(F.lit(1)).alias("ranges"), F.sum("count").alias("rows"),
                      (F.max("count") <= 1.5 * F.avg("count")).alias("even"))


def _in_chunk_order(policy):
    """Lines keyed by order and line number, which repeat, and loaded in chunks of parts."""
    def query(spark, sf):
        s = replace(step("l", maps(
            ("order_key", "DIRECT", "l.l_orderkey", "BIGINT"), ("line", "DIRECT", "l.l_linenumber", "INT"),
            ("part", "DIRECT", "l.l_partkey", "BIGINT"), ("price", "DIRECT", "l.l_extendedprice", "DECIMAL(12,2)")),
            keys=["order_key", "line"], policy=policy), chunking=Chunking("l.l_partkey", 40))
        store = _store(spark)
        staged, _ = stage_step(spark, s, {"l": table(spark, sf, "lineitem")}, store, "lines")
        result = load_step(spark, s, staged, store)
        return store.read("migrated", "result").withColumn("logged", F.lit(result.rejects).cast("bigint"))
    return query


# Target tables ---------------------------------------------------------------------------------

def structure_copy(spark, sf):
    """An empty copy of a loaded table, then filled."""
    store, orders = _store(spark), table(spark, sf, "orders")
    store.publish("a", "orders", orders.filter("o_orderstatus = 'F'"))
    store.copy_structure("a", "orders", "b", "orders")
    empty = store.read("b", "orders").count()
    store.publish("b", "orders", orders, mode="add")
    return store.read("b", "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
                                            F.lit(empty).cast("bigint").alias("rows_after_copy"))


def table_exists_skip(spark, sf):
    """A table that is there is left alone: its rows and the two answers."""
    store, nations = _store(spark), table(spark, sf, "customer")
    first = store.ensure("a", "customers", nations.schema)
    store.publish("a", "customers", nations, mode="add")
    second = store.ensure("a", "customers", nations.schema)
    return store.read("a", "customers").select(
        "c_custkey", "c_name", F.lit(first["created"]).alias("created"),
        F.lit(second["skipped_existing"]).alias("skipped_existing"))


def load_type_fit(spark, sf):
    """A target column narrower than its mapping, before and after its keys are met: what does not fit is
    NULL and listed, and the column keeps its type."""
    store, orders = _store(spark), table(spark, sf, "orders")
    store.create("migrated", "result", spark.createDataFrame([], "order_key bigint, cents int").schema)
    s = step("o", maps(
        ("order_key", "DIRECT", "o.o_orderkey", "BIGINT"),
        ("cents", "EXPRESSION", "CAST(CAST(o.o_totalprice AS DECIMAL(12,2)) * 10000 AS SIGNED)", "BIGINT")),
        keys=["order_key"], policy="UPSERT")
    listed = 0
    for name in ("first", "second"):
        staged, _ = stage_step(spark, s, {"o": orders}, store, name)
        listed += load_step(spark, s, staged, store).errors
    return store.read("migrated", "result").withColumn("listed", F.lit(listed).cast("bigint"))


# Streams ---------------------------------------------------------------------------------------

EVENTS = replace(step("e", maps(
    ("user_id", "DIRECT", "e.user_id", "BIGINT"), ("event_type", "DIRECT", "e.event_type", "TEXT"),
    ("event_id", "DIRECT", "e.event_id", "BIGINT"), ("value", "DIRECT", "e.value", "DECIMAL(10,2)"))),
    target=Target("migrated", "last_events", ("user_id", "event_type"), "UPSERT"))


def _event_files(spark, sf):
    """The events in files by rising id, so that a later batch holds later events."""
    folder = fresh_folder(spark, "events")
    events = table(spark, sf, "events")
    events.repartitionByRange(8, "event_id").write.parquet(folder)
    return file_stream(spark, folder, events.schema, files_per_batch=3), folder


def stream_load(spark, sf):
    """Each batch staged, then one UPSERT: the last event per user and type. Run again, nothing moves."""
    store, (stream, folder) = _store(spark), _event_files(spark, sf)
    s = replace(EVENTS, columns=(EVENTS.columns[2], *EVENTS.columns[:2], EVENTS.columns[3]),
                target=replace(EVENTS.target, keys=("event_id",)))
    for _ in range(2):
        run_stream(spark, stream, s, store, "events", f"{folder}-checkpoint")
    return store.read("migrated", "last_events")


def stream_ignore(spark, sf):
    """Keys shared by batches under IGNORE_AND_LOG, loaded onto the target once per run of the stream."""
    store, (stream, folder) = _store(spark), _event_files(spark, sf)
    s = replace(EVENTS, columns=EVENTS.columns[:2],
                target=Target("migrated", "kinds", ("user_id", "event_type"), "IGNORE"))
    run_stream(spark, stream, s, store, "events", f"{folder}-checkpoint")
    return store.read("migrated", "kinds")


def _stream_in_thirds(policy):
    """A stream whose files come in three thirds of the event ids, loaded after each; users have one row."""
    def query(spark, sf):
        store, folder = _store(spark), fresh_folder(spark, "events")
        events = table(spark, sf, "events")
        last = events.agg(F.max("event_id")).first()[0]
        s = replace(EVENTS, columns=(EVENTS.columns[0], EVENTS.columns[2], EVENTS.columns[3]),
                    target=replace(EVENTS.target, keys=("user_id",), policy=policy))
        logged = 0
        for third in range(3):
            events.filter(F.expr(f"event_id * 3 div ({last} + 1) = {third}")).write.mode("append").parquet(folder)
            stream = file_stream(spark, folder, events.schema)
            logged += run_stream(spark, stream, s, store, "events", f"{folder}-checkpoint").rejects
        return store.read("migrated", "last_events").withColumn("logged", F.lit(logged).cast("bigint"))
    return query


def stream_retry_ledger(spark, sf):
    """A load of two batches that dies after its errors and refused rows are written; then a third batch comes. Each
    bad value is listed once, with its batch, and each refused row is logged once."""
    folder, root = fresh_folder(spark, "events"), fresh_folder(spark, "tables")
    events = table(spark, sf, "events").withColumn("value", F.expr("IF(event_id % 5 = 0, 'n/a', CAST(CAST(value AS DECIMAL(10,2)) AS STRING))"))
    last = events.agg(F.max("event_id")).first()[0]
    s = replace(EVENTS, columns=(EVENTS.columns[2], EVENTS.columns[3]), target=replace(EVENTS.target, keys=("event_id",), policy="IGNORE_AND_LOG"))
    plain = TableStore(spark, root)
    plain.publish("migrated", "last_events", events.filter("event_id % 7 = 0").select("event_id", F.lit(0).cast("decimal(10,2)").alias("value")))

    def die(schema, name):
        if (schema, name) == ("migrated", "last_events"):
            raise Died

    for third, store in ((0, Interrupted(spark, root, die)), (1, Interrupted(spark, root, die)), (2, plain)):
        events.filter(F.expr(f"event_id * 3 div ({last} + 1) = {third}")).coalesce(1).write.mode("append").parquet(folder)
        try:
            run_stream(spark, file_stream(spark, folder, events.schema), s, store, "events", f"{folder}-checkpoint")
        except Died:
            pass
    errors = plain.read("migration_admin", "row_errors").select(F.col("row_identity")["event_id"].cast("bigint").alias("event_id"),
                                                                "batch_number", F.col("raw_value").alias("what"))
    log = plain.read("migrated", "migration_conflict_log").select("event_id", F.lit(None).cast("bigint").alias("batch_number"),
                                                                  F.col("reject_reason").alias("what"))
    return errors.unionByName(log)


def stream_rows(spark, sf):
    """Batches of at most a tenth of the events by number of rows: the first half, then, from the checkpoint on, the
    other. The loaded events, whether any batch was larger, and whether the batches have all rows once."""
    store, folder, events = _store(spark), fresh_folder(spark, "events"), table(spark, sf, "events")
    last, rows = events.agg(F.max("event_id"), F.count(F.lit(1))).first()
    size = rows // 10
    s = replace(EVENTS, columns=(EVENTS.columns[2], EVENTS.columns[0], EVENTS.columns[3]), target=replace(EVENTS.target, keys=("event_id",)))
    counts = []
    for half in (f"event_id <= {last // 2}", f"event_id > {last // 2}"):
        stage_row_batches(events.filter(half), folder, size, "event_id")
        run_stream(spark, row_stream(spark, folder, events.schema), s, store, "events", f"{folder}-checkpoint")
        counts = [r["rows_processed"] for r in stream_metrics(spark, store, "events").select("rows_processed").collect()]
    return store.read("migrated", "last_events").withColumns({
        "bounded": F.lit(max(counts) <= size), "whole": F.lit(sum(counts) == rows and len(counts) >= 10)})


def batch_metrics(spark, sf):
    store, (stream, folder) = _store(spark), _event_files(spark, sf)
    stage_stream(stream, EVENTS, store, "events", f"{folder}-checkpoint")
    return stream_metrics(spark, store, "events").agg(
        F.count(F.lit(1)).alias("batches"), F.sum("rows_processed").alias("rows_processed"),
        F.count_if(F.col("duration_ms") > 0).alias("timed"), F.max("batch_number").alias("last_batch"))


QUERIES = {
    "run_blueprint": run_blueprint_query, "run_migration": run_migration_query,
    "migration_customers": migration_customers, "migration_rerun": migration_rerun,
    "migration_report": migration_report, "chunked_load": chunked_load, "chunked_resume": chunked_resume,
    "chunked_commits_text_key": chunked_commits_text_key, "chunked_commits_decimal_key": chunked_commits_decimal_key,
    "chunked_resume_grown": chunked_resume_grown, "chunked_resume_late": chunked_resume_late,
    "chunk_plan_even": chunk_plan_even, "stream_retry_ledger": stream_retry_ledger, "stream_rows": stream_rows, "chunked_upsert_order": _in_chunk_order("UPSERT"),
    "chunked_ignore_log_order": _in_chunk_order("IGNORE_AND_LOG"), "chunk_metrics": chunk_metrics,
    "structure_copy": structure_copy, "table_exists_skip": table_exists_skip, "stream_load": stream_load,
    "load_type_fit": load_type_fit, "stream_upsert_keys": _stream_in_thirds("UPSERT"),
    "stream_ignore_log": _stream_in_thirds("IGNORE_AND_LOG"), "stream_ignore": stream_ignore, "batch_metrics": batch_metrics,
}

_SHIPPED = """
    WITH lines AS (
      SELECT o_orderkey AS order_key, l_linenumber AS line_no, p_name AS part_name,
             (l_extendedprice::DECIMAL(12,2) - l_linenumber)::DECIMAL(14,2) AS net, l_shipdate::DATE::VARCHAR AS shipped, 'LIVE' AS origin
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey
      WHERE l_shipdate >= TIMESTAMP '1997-01-01'
      UNION ALL
      SELECT -1 - o_orderkey, l_linenumber, 'part ' || l_partkey,
             CASE WHEN l_returnflag <> 'R' THEN l_extendedprice::DECIMAL(12,2) END::DECIMAL(14,2), l_shipdate::DATE::VARCHAR, 'PAPER'
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < TIMESTAMP '1997-01-01'),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY order_key, line_no ORDER BY part_name DESC NULLS LAST,
                 net DESC NULLS LAST, shipped DESC) AS n FROM lines)
"""
_SHIPPED_ROWS = _SHIPPED + " SELECT order_key, line_no, part_name, net, shipped, origin FROM ranked WHERE n = 1"
_ORDER_ROWS = "SELECT o_orderkey AS order_key, o_orderstatus AS status, o_totalprice::DECIMAL(12,2) AS price"

_THIRDS = """
    WITH thirds AS (SELECT *, event_id * 3 // ((SELECT max(event_id) FROM events) + 1) AS third FROM events),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id {way}) AS n FROM thirds)
    SELECT user_id, event_id, value::DECIMAL(10,2) AS value, {logged}::BIGINT AS logged FROM ranked WHERE n = 1"""

_CHUNK_ORDER = """
    WITH chunked AS (
      SELECT l_orderkey AS order_key, l_linenumber AS line, l_partkey AS part, l_extendedprice::DECIMAL(12,2) AS price,
             (l_partkey - (SELECT min(l_partkey) FROM lineitem)) // 40 + 1 AS chunk FROM lineitem),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY order_key, line ORDER BY chunk {way}, part {way}, price {way}) AS n
               FROM chunked)
    SELECT order_key, line, part, price, {logged}::BIGINT AS logged FROM ranked WHERE n = 1"""

ORACLE = {
    "run_blueprint": """
        SELECT c_custkey AS account, lower('Account/' || c_name) AS label, coalesce(n_name, 'abroad') AS nation,
               'TESTDATA' AS origin
        FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 4 WHERE c_acctbal > 0""",
    "run_migration": _SHIPPED_ROWS,
    "migration_rerun": _SHIPPED_ROWS,
    "migration_customers": """
        SELECT c_custkey AS account, c_name AS label, (c_acctbal >= 0)::INT AS in_credit, n_name AS nation
        FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > -500""",
    "migration_report": f"""{_SHIPPED}
        SELECT 'mig_lines' AS migration_id, TRUE AS success, 3::BIGINT AS blueprints_completed,
               ((SELECT count(*) FROM lines) + (SELECT count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey
                 WHERE c_acctbal > -500))::BIGINT AS rows_processed,
               3::BIGINT AS batches_processed,
               (SELECT count(*) FROM lines WHERE origin = 'PAPER' AND net IS NULL)::BIGINT AS row_error_count,
               '' AS message""",
    "chunked_load": f"""{_ORDER_ROWS}, ((o_orderkey - (SELECT min(o_orderkey) FROM orders)) // 2500 + 1)::BIGINT AS chunk
        FROM orders""",
    "chunked_resume": f"{_ORDER_ROWS} FROM orders",
    "chunked_commits_text_key": f"{_ORDER_ROWS} FROM orders",
    "chunked_commits_decimal_key": f"{_ORDER_ROWS} FROM orders".replace("o_orderkey", "o_custkey"),
    "chunked_resume_grown": f"{_ORDER_ROWS}, 1 AS found, 1 AS kept FROM orders",
    "chunked_resume_late": f"{_ORDER_ROWS}, 2 AS found, 1 AS kept FROM orders",
    "chunk_plan_even": "SELECT 8::BIGINT AS ranges, count(*)::BIGINT AS rows, TRUE AS even FROM lineitem",
    "stream_rows": "SELECT event_id, user_id, value::DECIMAL(10,2) AS value, TRUE AS bounded, TRUE AS whole FROM events",
    "stream_retry_ledger": """
        WITH e AS (SELECT event_id, event_id * 3 // ((SELECT max(event_id) FROM events) + 1) AS batch_number FROM events)
        SELECT event_id, batch_number::BIGINT AS batch_number, 'n/a' AS what FROM e WHERE event_id % 5 = 0
        UNION ALL SELECT event_id, NULL, 'DUPLICATE_KEY' FROM e WHERE event_id % 7 = 0""",
    "chunked_upsert_order": _CHUNK_ORDER.format(way="DESC", logged="0"),
    "chunked_ignore_log_order": _CHUNK_ORDER.format(
        way="ASC", logged="(SELECT count(*) FROM chunked c WHERE chunk > (SELECT min(chunk) FROM chunked f "
        "WHERE f.order_key = c.order_key AND f.line = c.line))"),
    "chunk_metrics": """
        SELECT 1 AS blueprint_sequence, ((o_orderkey - (SELECT min(o_orderkey) FROM orders)) // 2500 + 1)::BIGINT AS batch_number,
               count(*)::BIGINT AS rows_processed FROM orders GROUP BY 2""",
    "structure_copy": "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, 0::BIGINT AS rows_after_copy FROM orders",
    "table_exists_skip": "SELECT c_custkey, c_name, TRUE AS created, TRUE AS skipped_existing FROM customer",
    "stream_load": "SELECT event_id, user_id, event_type, value::DECIMAL(10,2) AS value FROM events",
    "load_type_fit": """
        WITH o AS (SELECT o_orderkey AS order_key, (o_totalprice::DECIMAL(12,2) * 10000)::BIGINT AS cents FROM orders)
        SELECT order_key, CASE WHEN cents <= 2147483647 THEN cents END::INT AS cents,
               (2 * (SELECT count(*) FROM o WHERE cents > 2147483647))::BIGINT AS listed FROM o""",
    "stream_upsert_keys": _THIRDS.format(way="DESC", logged="0"),
    "stream_ignore_log": _THIRDS.format(
        way="ASC", logged="(SELECT count(*) FROM thirds t WHERE third > (SELECT min(third) FROM thirds f "
        "WHERE f.user_id = t.user_id))"),
    "stream_ignore": "SELECT DISTINCT user_id, event_type FROM events",
    "batch_metrics": """
        SELECT 3::BIGINT AS batches, count(*)::BIGINT AS rows_processed, 3::BIGINT AS timed, 2::BIGINT AS last_batch
        FROM events""",
}
