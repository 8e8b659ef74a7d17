"""Joins of a step's sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.common import join, maps, run, step, table
from rowferry.operators.conflict import captured
from rowferry.operators.joins import join_source, range_join, rows_with_key_in, salted_join
from rowferry.sources.open import open_sources
from rowferry.spec import Condition, Connection, Join, Source
from rowferry.workspace import fresh_folder

PAIR = maps(("order_key", "DIRECT", "o.o_orderkey", "BIGINT"), ("customer_key", "DIRECT", "c.c_custkey", "BIGINT"),
            ("name", "DIRECT", "c.c_name", "TEXT"), ("price", "DIRECT", "o.o_totalprice", "DECIMAL(12,2)"))


def _pair(how):
    def query(spark, sf):
        s = step("c", PAIR, pre_filters=["c.c_acctbal > 5000"],
                 joins=[join("o", how, ("o.o_custkey", "=", "c.c_custkey"))])
        orders = table(spark, sf, "orders").filter("o_orderstatus = 'F'")
        return run(s, c=table(spark, sf, "customer"), o=orders)
    return query


def join_chain(spark, sf):
    s = step("l", maps(
        ("order_key", "DIRECT", "l.l_orderkey", "BIGINT"), ("line", "DIRECT", "l.l_linenumber", "INT"),
        ("price", "DIRECT", "l.l_extendedprice", "DECIMAL(12,2)"), ("status", "DIRECT", "o.o_orderstatus", "TEXT"),
        ("customer", "DIRECT", "c.c_name", "TEXT"), ("nation", "DIRECT", "n.n_name", "TEXT")),
        joins=[join("o", "INNER", ("o.o_orderkey", "=", "l.l_orderkey"), ("o.o_orderdate", "<=", "l.l_shipdate")),
               join("c", "LEFT", ("c.c_custkey", "=", "o.o_custkey"), ("c.c_acctbal", ">", "0")),
               join("n", "LEFT", ("n.n_nationkey", "=", "c.c_nationkey"))])
    return run(s, **{a: table(spark, sf, t) for a, t in zip("locn", ("lineitem", "orders", "customer", "nation"))})


def join_case_key(spark, sf):
    s = step("o", maps(("order_key", "DIRECT", "o.o_orderkey", "BIGINT"), ("name", "DIRECT", "c.c_name", "TEXT")),
             joins=[join("c", "LEFT", ("CASE WHEN o.o_orderstatus = 'F' THEN o.o_custkey ELSE o.o_orderkey END",
                                       "=", "c.c_custkey"))])
    return run(s, o=table(spark, sf, "orders"), c=table(spark, sf, "customer"))


def join_range(spark, sf):
    s = step("l", maps(
        ("order_key", "DIRECT", "l.l_orderkey", "BIGINT"), ("line", "DIRECT", "l.l_linenumber", "INT"),
        ("price", "DIRECT", "l.l_extendedprice", "DECIMAL(12,2)"), ("part", "DIRECT", "p.p_name", "TEXT")),
        joins=[join("p", "LEFT", ("p.p_partkey", "=", "l.l_partkey"), ("l.l_extendedprice", ">=", "p.p_retailprice * 20"),
                    ("l.l_extendedprice", "<", "p.p_retailprice * 60"), ("p.p_type", "!=", "'SMALL'"))])
    return run(s, l=table(spark, sf, "lineitem"), p=table(spark, sf, "part"))


def join_range_striped(spark, sf):
    orders, bands = table(spark, sf, "orders").alias("o"), table(spark, sf, "nation").alias("n")
    found = range_join(orders, bands, "o.o_totalprice", "n.n_nationkey * 20000.0", "n.n_nationkey * 20000.0 + 15000.0",
                       20000.0, "LEFT")
    return found.select(F.col("o.o_orderkey").alias("order_key"), F.col("n.n_name").alias("band"))


def join_range_striped_full(spark, sf):
    """Bands above the greatest price, which hold no order, and orders between two bands."""
    orders, bands = table(spark, sf, "orders").alias("o"), table(spark, sf, "nation").alias("n")
    found = range_join(orders, bands, "o.o_totalprice", "n.n_nationkey * 40000.0", "n.n_nationkey * 40000.0 + 30000.0",
                       20000.0, "FULL")
    return found.select(F.col("o_orderkey").alias("order_key"), F.col("n_name").alias("band"))


def join_range_dates(spark, sf):
    """Moments in ranges of days."""
    orders, spans = table(spark, sf, "orders").alias("o"), table(spark, sf, "nation").alias("n")
    found = range_join(orders, spans, "o.o_orderdate", "date_add(DATE'1995-01-01', n.n_nationkey * 90)",
                       "date_add(DATE'1995-01-01', n.n_nationkey * 90 + 60)", 90 * 86400, "RIGHT")
    return found.select(F.col("o_orderkey").alias("order_key"), F.col("n_name").alias("span"))


def join_salted_full_range(spark, sf):
    """Hot keys in a FULL join that also compares prices."""
    orders = table(spark, sf, "orders").alias("o")
    tops = (orders.groupBy("o_orderpriority", "o_orderstatus")
            .agg((F.max("o_totalprice") + F.when(F.col("o_orderstatus") == "P", 1.0).otherwise(0.0)).alias("top")).alias("r"))
    out = salted_join(orders, tops, "r", [Condition("o.o_orderpriority", "=", "r.o_orderpriority"),
                                          Condition("o.o_totalprice", ">=", "r.top")], "FULL", hot_rows=100)
    return out.toDF(*[f"{'r_' if i >= len(orders.columns) else ''}{c}" for i, c in enumerate(out.columns)]).select(
        F.col("o_orderkey").alias("order_key"), F.col("r_o_orderpriority").alias("priority"), F.col("r_o_orderstatus").alias("status"))


def join_salted(spark, sf):
    # hot_rows low enough that the fixture has hot keys: priorities hold a fifth of all orders each
    orders = table(spark, sf, "orders").alias("o")
    rates = (orders.filter("o_orderstatus = 'F'").groupBy("o_orderpriority")
             .agg(F.max("o_orderkey").alias("top_key")).alias("r"))
    out = salted_join(orders, rates, "r", [Condition("o.o_orderpriority", "=", "r.o_orderpriority")], "LEFT",
                      hot_rows=100)
    return out.select(F.col("o.o_orderkey").alias("order_key"), F.col("r.top_key").alias("top_key"))


def join_range_dyadic(spark, sf):
    """Ranges of 1 to 10^12 keys in all kinds of join, by the kind and the range: rows and sum of keys. The last
    ranges lie above all keys, the first keys below all ranges."""
    orders = table(spark, sf, "orders").select("o_orderkey").alias("o")
    ranges = table(spark, sf, "nation").select(
        "n_name", F.expr("CAST(IF(n_nationkey < 20, 500 + n_nationkey * 10, pow(10, 13)) AS BIGINT)").alias("low"),
        F.expr("CAST(pow(10, n_nationkey % 13) AS BIGINT)").alias("width")).alias("n")
    found = None
    for how in ("INNER", "LEFT", "RIGHT", "FULL"):
        conditions = Condition("o.o_orderkey", ">=", "n.low"), Condition("n.low + n.width", ">", "o.o_orderkey")
        rows = join_source(orders, ranges, Join(Source("n", "data", "nation"), conditions, how))
        counts = rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys"))
        counts = counts.withColumn("kind", F.lit(how))
        found = counts if found is None else found.unionByName(counts)
    return found


def join_salted_zipf(spark, sf):
    """Most keys are hot, small ones most; each is spread by the number of its rows."""
    lines = table(spark, sf, "lineitem").withColumn("k", F.expr("l_partkey div l_linenumber")).alias("l")
    parts = table(spark, sf, "part").alias("p")
    out = salted_join(lines, parts, "p", [Condition("l.k", "=", "p.p_partkey"), Condition("l.l_quantity", ">=", "p.p_size / 2")],
                      "LEFT", hot_rows=3)
    return out.select(F.col("l.l_orderkey").alias("order_key"), F.col("l.k").alias("k"), F.col("p.p_name").alias("part"))


def join_cross_source(spark, sf):
    folder = fresh_folder(spark, "csv")
    table(spark, sf, "nation").write.option("header", True).csv(f"{folder}/nations.csv")
    s = step("c", maps(("id", "DIRECT", "c.c_custkey", "BIGINT"), ("nation", "DIRECT", "n.n_name", "TEXT"),
                       ("region", "DIRECT", "n.n_regionkey", "INT")),
             joins=[join("n", "LEFT", ("n.n_nationkey", "=", "c.c_nationkey"), ("n.n_regionkey", "<", "3"))])
    s = _from(s, "n", "archive", "nations.csv")
    s = _from(s, "c", "lake", "customer")
    places = {"archive": Connection("CSV_S3_BUCKET", f"{folder}/"), "lake": Connection("PARQUET", sf)}
    return run(s, **open_sources(spark, s, places))


def _from(s, alias, connection, name):
    from dataclasses import replace
    if s.root.alias == alias:
        return replace(s, root=replace(s.root, connection=connection, table=name))
    return replace(s, joins=tuple(
        replace(j, source=replace(j.source, connection=connection, table=name)) if j.source.alias == alias else j
        for j in s.joins))


LINES = ["l_orderkey", "l_linenumber"]


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(*LINES, "l_partkey", F.col("l_extendedprice").cast("decimal(12,2)").alias("price"))


def _returned(spark, sf):
    """A target: the keys with a returned line."""
    return table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(*LINES).distinct()


def pk_match(spark, sf):
    return rows_with_key_in(_lines(spark, sf), _returned(spark, sf), LINES)


def conflict_capture(spark, sf):
    return captured(_returned(spark, sf), _lines(spark, sf), LINES, hot_rows=4)


QUERIES = {
    **{f"join_{how.lower()}": _pair(how) for how in ("INNER", "LEFT", "RIGHT", "FULL")},
    "join_chain": join_chain, "join_case_key": join_case_key, "join_range": join_range,
    "join_range_striped": join_range_striped, "join_range_striped_full": join_range_striped_full,
    "join_range_dates": join_range_dates, "join_salted": join_salted, "join_salted_full_range": join_salted_full_range,
    "join_range_dyadic": join_range_dyadic, "join_salted_zipf": join_salted_zipf,
    "join_cross_source": join_cross_source, "pk_match": pk_match, "conflict_capture": conflict_capture,
}

_PAIR_SQL = """
    SELECT o_orderkey AS order_key, c_custkey AS customer_key, c_name AS name, o_totalprice::DECIMAL(12,2) AS price
    FROM (SELECT * FROM customer WHERE c_acctbal > 5000) {how} JOIN
         (SELECT * FROM orders WHERE o_orderstatus = 'F') ON o_custkey = c_custkey"""
_MATCH_SQL = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice::DECIMAL(12,2) AS price{more}
    FROM lineitem l WHERE EXISTS (SELECT 1 FROM lineitem t WHERE t.l_returnflag = 'R'
      AND t.l_orderkey = l.l_orderkey AND t.l_linenumber = l.l_linenumber)"""

_DYADIC_SQL = """
    WITH n AS (SELECT n_name, (CASE WHEN n_nationkey < 20 THEN 500 + n_nationkey * 10 ELSE 10000000000000 END)::BIGINT AS low,
                      (10 ** (n_nationkey % 13))::BIGINT AS width FROM nation)
    """ + " UNION ALL ".join(f"""
    SELECT n_name, count(*)::BIGINT AS rows, sum(o_orderkey)::BIGINT AS keys, '{how}' AS kind
    FROM orders {how} JOIN n ON o_orderkey >= low AND o_orderkey < low + width GROUP BY 1""" for how in ("INNER", "LEFT", "RIGHT", "FULL"))

ORACLE = {
    "join_range_dyadic": _DYADIC_SQL,
    "join_salted_zipf": """
        SELECT l_orderkey AS order_key, l_partkey // l_linenumber AS k, p_name AS part
        FROM lineitem LEFT JOIN part ON p_partkey = l_partkey // l_linenumber AND l_quantity >= p_size / 2""",
    **{f"join_{how.lower()}": _PAIR_SQL.format(how=how) for how in ("INNER", "LEFT", "RIGHT", "FULL")},
    "join_chain": """
        SELECT l_orderkey AS order_key, l_linenumber AS line, l_extendedprice::DECIMAL(12,2) AS price,
               o_orderstatus AS status, c_name AS customer, n_name AS nation
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderdate <= l_shipdate
        LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0
        LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "join_case_key": """
        SELECT o_orderkey AS order_key, c_name AS name FROM orders
        LEFT JOIN customer ON CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE o_orderkey END = c_custkey""",
    "join_range": """
        SELECT l_orderkey AS order_key, l_linenumber AS line, l_extendedprice::DECIMAL(12,2) AS price, p_name AS part
        FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND l_extendedprice >= p_retailprice * 20
         AND l_extendedprice < p_retailprice * 60 AND p_type <> 'SMALL'""",
    "join_range_striped": """
        SELECT o_orderkey AS order_key, n_name AS band FROM orders
        LEFT JOIN nation ON o_totalprice >= n_nationkey * 20000.0 AND o_totalprice < n_nationkey * 20000.0 + 15000.0""",
    "join_range_striped_full": """
        WITH bands AS (SELECT n_name, n_nationkey * 40000.0 AS lo, n_nationkey * 40000.0 + 30000.0 AS hi FROM nation)
        SELECT o_orderkey AS order_key, n_name AS band FROM orders LEFT JOIN bands ON o_totalprice >= lo AND o_totalprice < hi
        UNION ALL SELECT NULL, n_name FROM bands
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice >= lo AND o_totalprice < hi)""",
    "join_range_dates": """
        SELECT o_orderkey AS order_key, n_name AS span FROM nation LEFT JOIN orders
          ON o_orderdate >= DATE '1995-01-01' + (n_nationkey * 90)::INT
         AND o_orderdate < DATE '1995-01-01' + (n_nationkey * 90 + 60)::INT""",
    "join_salted_full_range": """
        WITH tops AS (SELECT o_orderpriority AS p, o_orderstatus AS s,
                             max(o_totalprice) + CASE WHEN o_orderstatus = 'P' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS top
                      FROM orders GROUP BY 1, 2)
        SELECT o_orderkey AS order_key, p AS priority, s AS status
        FROM orders LEFT JOIN tops ON p = o_orderpriority AND o_totalprice >= top
        UNION ALL SELECT NULL, p, s FROM tops
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE p = o_orderpriority AND o_totalprice >= top)""",
    "join_salted": """
        SELECT o_orderkey AS order_key, top_key FROM orders o
        LEFT JOIN (SELECT o_orderpriority AS p, max(o_orderkey) AS top_key FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
          ON p = o_orderpriority""",
    "join_cross_source": """
        SELECT c_custkey AS id, n_name AS nation, n_regionkey AS region
        FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3""",
    "pk_match": _MATCH_SQL.format(more=""),
    "conflict_capture": _MATCH_SQL.format(more=", 'DUPLICATE_KEY' AS reject_reason"),
}
