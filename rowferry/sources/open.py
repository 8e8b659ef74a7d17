"""A source of a step as a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.operators.shape import MALFORMED
from rowferry.sources.csv_files import DELIMITER, ENCODING, QUOTE, read_csv
from rowferry.sources.jdbc import DRIVERS, read_table
from rowferry.spec import Connection, Source, Step

READ_PARTS = 64  # tasks of a database read whose key range is known but whose size is not


def _under(base: str, name: str) -> str:
    return base + name if base.endswith("/") else f"{base}/{name}"


def collated(df: DataFrame, collation: str) -> DataFrame:
    """The rows with all text compared under a collation of Spark, such as UTF8_LCASE or UNICODE_CI: in
    predicates, derivations, join conditions and orders. The values stay as they are."""
    return df.withColumns({f.name: F.collate(F.col(f"`{f.name}`"), collation) for f in df.schema.fields if isinstance(f.dataType, T.StringType)})


def open_source(
    spark: SparkSession, source: Source, connections: Mapping[str, Connection], **read_options,
) -> DataFrame:
    """The rows of a source: a database table, a CSV file or a Parquet folder. A connection may name the
    ``collation`` that its text is compared under."""
    connection = connections[source.connection]
    rows = _rows(spark, source, connection, **read_options)
    return collated(rows, connection.options["collation"]) if connection.options.get("collation") else rows


def _rows(spark: SparkSession, source: Source, connection: Connection, **read_options) -> DataFrame:
    if connection.kind == "CSV_S3_BUCKET":
        base = connection.location
        base = "s3a" + base[2:] if base.startswith("s3:") else base
        return read_csv(spark, _under(base, source.table), **read_options)
    if connection.kind == "LOCAL_CSV":
        given = connection.options.get("parse_options") or {}
        path = connection.location
        if not path.lower().endswith(".csv"):
            path = _under(path, source.table)
        return read_csv(spark, path, **{
            "delimiter": given.get("delimiter", DELIMITER), "quote": given.get("quote", QUOTE),
            "header_row": int(given.get("header_row", 1)), "encoding": given.get("encoding", ENCODING),
            **read_options})
    if connection.kind == "PARQUET":
        return spark.read.parquet(_under(connection.location, f"{source.table}.parquet"))
    return read_table(spark, connection, source.schema, source.table, **read_options)


def open_sources(
    spark: SparkSession, step: Step, connections: Mapping[str, Connection],
    read_options: Mapping[str, Mapping] | None = None,
) -> dict[str, DataFrame]:
    """All sources of a step by alias.

    ``read_options`` are per alias: ``key``, ``parts``, ``part_rows`` and ``even`` of a database read in key
    ranges, ``schema`` of a CSV file. The root of a chunked step is read in ranges of its chunk column unless they say
    otherwise; any other database table is one task without them, so give them for large ones. CSV
    files also have the text of their malformed records, for the error ledger.
    """
    given = {alias: dict(options) for alias, options in (read_options or {}).items()}
    root = step.root
    if step.chunking and connections[root.connection].kind in DRIVERS:
        key = step.chunking.column.rsplit(".", 1)[-1]
        given[root.alias] = {"key": key, "parts": READ_PARTS, **given.get(root.alias, {})}
    every = [root, *(j.source for j in step.joins)]
    for source in every:
        if connections[source.connection].kind in ("CSV_S3_BUCKET", "LOCAL_CSV"):
            given[source.alias] = {"malformed": MALFORMED, **given.get(source.alias, {})}
    return {s.alias: open_source(spark, s, connections, **given.get(s.alias, {})) for s in every}
