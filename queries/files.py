"""CSV files, staged copies and key ranges of a partitioned read.

The CSV files are copies of the test tables, written by Spark to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from queries.casts import DAYS, MOMENTS, NUMBERS
from queries.common import table
from rowferry.plans.migration import run_migration
from rowferry.sources.csv_files import csv_columns, csv_types, list_csv_files, read_csv
from rowferry.sources.jdbc import key_ranges, range_number, read_ranges
from rowferry.sources.staging import stage
from rowferry.sinks.tables import TableStore
from rowferry.spec import migration_from
from rowferry.workspace import fresh_folder


def _documents_csv(spark, sf):
    """Texts with commas, quotes and other scripts; line breaks become blanks."""
    folder = fresh_folder(spark, "csv")
    one_line = F.regexp_replace("text", r"[\r\n\u0085  ]+", " ")
    (table(spark, sf, "documents").select("doc_id", one_line.alias(" text "), "lang", F.nullif("source", F.lit("web")).alias("source"))
     .write.option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder))
    return folder


def csv_scan(spark, sf):
    df = read_csv(spark, _documents_csv(spark, sf))
    return df.select(F.col("doc_id").cast("bigint"), F.md5("text").alias("text_md5"), "lang", "source")


def csv_options(spark, sf):
    """Semicolons, single quotes, and a header in row 3 below two lines of remarks."""
    folder = fresh_folder(spark, "csv")
    line = F.concat_ws(";", "c_custkey", F.concat(F.lit("'"), "c_name", F.lit("; "), "c_mktsegment", F.lit("'")), "c_nationkey")

    def with_head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["exported; by hand", "--", "id; name ;nation"]})
        yield from batches

    customers = table(spark, sf, "customer").repartition(3)
    customers.select(line.alias("value")).mapInPandas(with_head, "value string").write.text(folder)
    df = read_csv(spark, folder, delimiter=";", quote="'", header_row=3)
    return df.select(F.col("id").cast("bigint"), "name", F.col("nation").cast("int"))


def csv_options_utf16(spark, sf):
    """Two-byte characters, with the header in row 3; names get letters beyond Latin ones."""
    folder = fresh_folder(spark, "csv")
    line = F.concat_ws(";", "c_custkey", F.concat(F.lit("'"), "c_name", F.lit("; \u0a0a\u4e0a'")), "c_nationkey")
    remarks = spark.createDataFrame([("", "exported; by hand"), ("", "--"), ("", "id; name ;nation")], "part string, value string")
    parts = table(spark, sf, "customer").select(F.pmod("c_custkey", F.lit(3)).cast("string").alias("part"), line.alias("value"))
    files = remarks.crossJoin(parts.select(F.col("part").alias("file")).distinct()).select("file", "value", F.monotonically_increasing_id().alias("n"))
    rows = files.unionByName(parts.select(F.col("part").alias("file"), "value", F.lit(1 << 60).alias("n")))
    (rows.repartition("file").sortWithinPartitions("file", "n").drop("n").write.partitionBy("file").option("encoding", "UTF-16LE")
     .option("sep", "\u0001").option("quote", "\u0000").csv(folder))
    df = read_csv(spark, f"{folder}/*", delimiter=";", quote="'", header_row=3, encoding="utf-16-le")
    return df.select(F.col("id").cast("bigint"), "name", F.col("nation").cast("int"))


def csv_mixed_headers(spark, sf):
    """Files of one folder whose headers have the same names in another order, in row 1 and in row 3: refused
    together, and read one by one."""
    both = None
    for row in (1, 3):
        folder = fresh_folder(spark, "csv")
        for names in (("key0", "name1"), ("name1", "key0")):
            part = table(spark, sf, "customer").select(F.col("c_custkey").alias("key0"), F.col("c_name").alias("name1")).filter(
                F.col("key0") % 2 == ("key0", "name1").index(names[0]))
            line = F.concat_ws(",", *names)

            def with_head(batches: Iterator[pd.DataFrame], head=["remark"] * (row - 1) + [",".join(names)]) -> Iterator[pd.DataFrame]:
                yield pd.DataFrame({"value": head})
                yield from batches

            part.select(line.alias("value")).coalesce(1).mapInPandas(with_head, "value string").write.mode("append").text(f"{folder}/{names[0]}")
        try:
            read_csv(spark, f"{folder}/*", header_row=row).collect()
            refused = False
        except Exception as error:  # noqa: BLE001 - Spark's own error or ours
            refused = "header" in str(error).lower()
        for name in ("key0", "name1"):
            df = read_csv(spark, f"{folder}/{name}", header_row=row).select(
                F.col("key0").cast("bigint"), "name1", F.lit(row).alias("header_row"), F.lit(refused).alias("refused"))
            both = df if both is None else both.unionByName(df)
    return both


def csv_malformed_joined(spark, sf):
    """Malformed records of a joined file are listed, also those that meet no root row."""
    folder, store = fresh_folder(spark, "csv"), TableStore(spark, fresh_folder(spark, "tables"))
    line = F.expr("concat_ws(',', c_custkey, IF(c_custkey % 7 = 0, NULL, c_name), IF(c_custkey % 5 = 0, c_mktsegment, NULL))")

    def with_head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["id,name"]})
        yield from batches

    table(spark, sf, "customer").select(line.alias("value")).mapInPandas(with_head, "value string").write.text(f"{folder}/names.csv")
    migration = migration_from({
        "migration_id": "m", "client_id": "c", "version": "1", "connections": {
            "lake": {"type": "PARQUET", "path": sf}, "files": {"type": "CSV_S3_BUCKET", "s3_bucket_uri": f"{folder}/", "aws_region": "eu"}},
        "blueprints": [{
            "sequence_order": 1, "target": {"connection_ref": "lake", "on_conflict": "UPSERT", "schema": "a", "table_name": "b", "primary_keys": ["key"]},
            "sources": {"root_table": {"connection_ref": "lake", "schema": "x", "table_name": "orders", "alias": "o"},
                        "joins": [{"join_type": "INNER", "connection_ref": "files", "file_name": "names.csv", "alias": "n",
                                   "conditions": [{"left_expression": "n.id", "operator": "=", "right_expression": "o.o_custkey"}]}]},
            "chunking_strategy": {"is_enabled": False}, "pre_filters": ["o.o_custkey < 20"], "post_filters": [], "derivations": [],
            "mappings": [{"target_column": "key", "source_type": "DIRECT", "source_value": "o.o_orderkey", "cast_to": "BIGINT", "is_nullable": False}]}]})
    run_migration(spark, migration, store)
    return store.read("migration_admin", "row_errors").select(
        "error_code", F.col("row_identity")["n"].alias("record"), F.col("raw_value").alias("raw"))


def csv_malformed(spark, sf):
    """Records with a cell too many or too few beside good ones."""
    folder = fresh_folder(spark, "csv")
    line = F.expr("concat_ws(',', c_custkey, IF(c_custkey % 7 = 0, NULL, c_name), IF(c_custkey % 5 = 0, c_mktsegment, NULL))")

    def with_head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["id,name"]})
        yield from batches

    table(spark, sf, "customer").select(line.alias("value")).mapInPandas(with_head, "value string").write.text(folder)
    df = read_csv(spark, folder, malformed="record")
    return df.select(F.col("id").cast("bigint"), "name", "record")


HEADED = ("nation", "customer", "lineitem", "documents")


def csv_columns_query(spark, sf):
    """The headers of the files of four tables, one with a name between blanks and texts that may have line breaks."""
    found = None
    for name in HEADED:
        folder = fresh_folder(spark, "csv")
        rows = table(spark, sf, name).withColumnsRenamed({"text": " text "})
        (rows.write.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(folder))
        columns = csv_columns(spark, folder).select(F.lit(name).alias("name"), "position", "column_name", "data_type").distinct()
        found = columns if found is None else found.unionByName(columns)
    return found


def csv_files(spark, sf):
    """Listed files by the folder of their language, with all their bytes: the header as a file of its own, the rows in as
    many files as there are tasks."""
    folder = fresh_folder(spark, "csv")
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.md5("text").alias("digest"), F.coalesce("lang", F.lit("none")).alias("lang"))
    heads = rows.select(F.lit("doc_id").alias("doc_id"), F.lit("digest").alias("digest"), "lang").distinct()
    for part in (heads, rows):
        part.write.mode("append").partitionBy("lang").csv(folder)
    listed = list_csv_files(spark, folder)
    return listed.groupBy(F.regexp_extract("key", "/lang=([^/]+)/[^/]+$", 1).alias("lang")).agg(
        F.sum("size").cast("bigint").alias("size"),
        F.every(F.expr("endswith(name, '.csv') AND endswith(key, concat('/', name))")).alias("named"),
        F.every(F.col("modified").isNotNull()).alias("dated"))


def csv_types_query(spark, sf):
    folder = fresh_folder(spark, "csv")
    orders = table(spark, sf, "orders")
    (orders.select(
        "o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(12,2)").alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("moment"),
        "o_orderpriority", F.expr(NUMBERS).alias("dirty_number"), F.expr(DAYS).alias("dirty_day"),
        F.expr(MOMENTS).alias("dirty_moment"), F.lit(None).cast("string").alias("empty"))
     .write.option("header", True).csv(folder))
    return csv_types(read_csv(spark, folder)).withColumn("filled", F.col("filled").cast("bigint"))


def stage_source(spark, sf):
    """Staged twice under one name: the second copy replaces the first."""
    store = TableStore(spark, fresh_folder(spark, "tables"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    stage(spark, lines.filter("l_returnflag = 'R'"), "lines", store)
    return stage(spark, lines, "lines", store)


def source_ranges(spark, sf):
    """The key ranges of a partitioned read, applied to orders: every row in exactly one."""
    orders = table(spark, sf, "orders")
    lo, hi = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    number = range_number(F.col("o_orderkey"), key_ranges("o_orderkey", lo, hi, 6))
    return orders.groupBy(number.alias("part")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("min_key"), F.max("o_orderkey").alias("max_key"))


def source_ranges_even(spark, sf):
    """The ranges of an even read of a key that is dense at its low end: rows by range against the mean, and whether
    each row is in exactly one."""
    lines = table(spark, sf, "lineitem").select(F.expr("l_partkey * l_partkey * l_partkey").alias("key"))
    lo, hi, rows = lines.agg(F.min("key"), F.max("key"), F.count(F.lit(1))).first()
    ranges = read_ranges("key", lo, hi, rows, 8, None, True, lambda given: lines.where(" OR ".join(f"({r})" for r in given)))
    hits = [F.when(F.expr(r), 1).otherwise(0) for r in ranges]
    counts = (lines.select(range_number(F.col("key"), ranges).alias("part"), sum(hits[1:], hits[0]).alias("hits"))
              .groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.max("hits").alias("hits")))
    return counts.agg(F.count(F.lit(1)).alias("ranges"), F.sum("rows").alias("rows"), (F.max("hits") == 1).alias("once"),
                      (F.max("rows") <= 1.5 * F.avg("rows")).alias("even"))


QUERIES = {
    "csv_scan": csv_scan, "csv_options": csv_options, "csv_options_utf16": csv_options_utf16,
    "csv_mixed_headers": csv_mixed_headers, "csv_malformed_joined": csv_malformed_joined, "csv_malformed": csv_malformed, "csv_columns": csv_columns_query, "csv_files": csv_files,
    "csv_types": csv_types_query, "stage_source": stage_source, "source_ranges": source_ranges, "source_ranges_even": source_ranges_even,
}

ORACLE = {
    "source_ranges_even": "SELECT 8::BIGINT AS ranges, count(*)::BIGINT AS rows, TRUE AS once, TRUE AS even FROM lineitem",
    "csv_scan": r"""
        SELECT doc_id, md5(regexp_replace(text, '[\r\n\x{85}\x{2028}\x{2029}]+', ' ', 'g')) AS text_md5, lang,
               nullif(source, 'web') AS source
        FROM documents""",
    "csv_options": "SELECT c_custkey AS id, c_name || '; ' || c_mktsegment AS name, c_nationkey AS nation FROM customer",
    "csv_malformed": """
        SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN c_name WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS name,
               CASE WHEN (c_custkey % 7 = 0) <> (c_custkey % 5 = 0) THEN
                 concat_ws(',', c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name END,
                           CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END) END AS record
        FROM customer""",
    "csv_options_utf16": "SELECT c_custkey AS id, c_name || '; \u0a0a\u4e0a' AS name, c_nationkey AS nation FROM customer",
    "csv_mixed_headers": "SELECT c_custkey AS key0, c_name AS name1, n::INT AS header_row, TRUE AS refused FROM customer, (VALUES (1), (3)) r(n)",
    "csv_malformed_joined": """
        SELECT 'MALFORMED_RECORD' AS error_code, concat_ws(',', c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name END,
               CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END) AS record, record AS raw
        FROM customer WHERE (c_custkey % 7 = 0) <> (c_custkey % 5 = 0)""",
    "csv_columns": " UNION ALL ".join(f"""
        SELECT '{name}' AS name, (row_number() OVER () - 1)::INT AS position, column_name, 'string' AS data_type FROM (DESCRIBE {name})"""
        for name in HEADED),
    "csv_files": """
        SELECT coalesce(lang, 'none') AS lang, (sum(length(doc_id::VARCHAR) + 34) + 14)::BIGINT AS size, TRUE AS named, TRUE AS dated
        FROM documents GROUP BY 1""",
    "csv_types": f"""
        WITH n AS (SELECT count(*)::BIGINT AS filled FROM orders)
        SELECT p AS position, c AS column_name, filled, t AS suggested FROM n, (VALUES
          (0, 'o_orderkey', 'BIGINT'), (1, 'o_custkey', 'BIGINT'), (2, 'price', 'DECIMAL'), (3, 'day', 'DATE'),
          (4, 'moment', 'DATETIME'), (5, 'o_orderpriority', 'TEXT')) v(p, c, t)
        UNION ALL SELECT 6, 'dirty_number', (count(*) FILTER (WHERE trim({NUMBERS}) <> ''))::BIGINT, 'TEXT' FROM orders
        UNION ALL SELECT 7, 'dirty_day', (count(*) FILTER (WHERE trim({DAYS}) <> ''))::BIGINT, 'TEXT' FROM orders
        UNION ALL SELECT 8, 'dirty_moment', (count(*) FILTER (WHERE trim({MOMENTS}) <> ''))::BIGINT, 'TEXT' FROM orders
        UNION ALL SELECT 9, 'empty', 0::BIGINT, 'TEXT'""",
    "stage_source": "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem",
    "source_ranges": """
        WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders)
        SELECT ((o_orderkey - lo) // ((hi - lo + 6) // 6))::BIGINT AS part, count(*)::BIGINT AS rows,
               min(o_orderkey) AS min_key, max(o_orderkey) AS max_key
        FROM orders, b GROUP BY 1""",
}
