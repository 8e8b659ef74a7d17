"""CSV files: reading, listing, header discovery and type hints."""

from __future__ import annotations

import codecs
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.casts import DATE_PATTERN, DATETIME_PATTERN, INTEGER_PATTERN, NUMBER_PATTERN

# The parse options of a plain file.
DELIMITER, QUOTE, ENCODING = ",", '"', "utf-8"


def _charset(encoding: str) -> str:
    """The name Spark has for an encoding that Python knows by several."""
    names = {"iso8859-1": "iso-8859-1", "ascii": "us-ascii", "utf-16-le": "utf-16le", "utf-16-be": "utf-16be"}
    known = codecs.lookup(encoding).name
    return names.get(known, known)


def _one_character(value: str, what: str) -> str:
    if len(value) != 1:
        raise ValueError(f"{what} must be one character")
    return value


def _check_options(delimiter: str, quote: str, header_row: int) -> None:
    _one_character(delimiter, "delimiter")
    _one_character(quote, "quote")
    if header_row < 1:
        raise ValueError("header_row must be at least 1")


def _header_cells():
    """A function (lines, delimiter, quote, row) -> the column names in that record.

    Lines are drawn until the record is whole, which an even number of quotes tells, so a header of
    any length is read and no more than it. The function stands alone, so that it can be sent to
    workers which do not have this package.
    """
    def cells(lines, delimiter: str, quote: str, row: int) -> list[str]:
        import csv
        held, found = [], 0
        for line in lines:
            held.append(line if found or held else line.removeprefix("\ufeff"))
            if sum(part.count(quote) for part in held) % 2:
                continue
            found += 1
            if found == row:
                break
            held = []
        else:
            raise ValueError("a quote is left open" if held else f"no record {row}, the file has {found}")
        record = next(csv.reader(held, delimiter=delimiter, quotechar=quote), [])
        names = [c.strip() or f"_c{at}" for at, c in enumerate(record)]
        if not "".join(record).strip():
            raise ValueError(f"record {row} names no column")
        return names

    return cells


def header_names(sample: str, delimiter: str = DELIMITER, quote: str = QUOTE, header_row: int = 1) -> list[str]:
    """Column names from the text of a file: trimmed, a blank one is called ``_c<position>``."""
    _check_options(delimiter, quote, header_row)
    return _header_cells()(sample.splitlines(keepends=True), delimiter, quote, header_row)


def list_csv_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, key, size, modified) of the ``*.csv`` files under a folder, ordered by name.

    Only the listing is read: the content column is pruned away. ``modified`` is NULL for an empty
    file.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.[cC][sS][vV]").load(folder))
    found = files.select(F.col("path").alias("key"), F.col("length").alias("size"),
                         F.col("modificationTime").alias("modified"))
    # the scan passes over files without content; the file index has their paths as URIs
    uris = spark.createDataFrame([(uri,) for uri in files.inputFiles()], "uri string")
    path = F.regexp_replace(F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    empty = uris.select(path.alias("key")).join(found, "key", "left_anti")
    name = F.element_at(F.split("key", "/"), -1)
    return (found.unionByName(empty.withColumn("size", F.lit(0).cast("bigint")), allowMissingColumns=True)
            .select(name.alias("name"), "key", "size", "modified").orderBy(F.lower("name"), "key"))


def csv_columns(
    spark: SparkSession, folder: str, *, delimiter: str = DELIMITER, quote: str = QUOTE,
    header_row: int = 1, encoding: str = ENCODING,
) -> DataFrame:
    """(file, position, column_name, data_type) of every CSV file under a folder.

    The listing is spread over tasks and each reads its files' headers, as far as they reach, so the
    cost follows the number of files, not their size. A file without a header is an error.
    """
    _check_options(delimiter, quote, header_row)
    cells = _header_cells()

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        from pyarrow import fs
        for files in batches:
            rows = []
            for name, key in zip(files["name"], files["key"]):
                uri = "s3" + key[3:] if key.startswith(("s3a:", "s3n:")) else key
                system, place = fs.FileSystem.from_uri(uri)
                with system.open_input_stream(place) as stream:
                    lines = io.TextIOWrapper(stream, encoding=encoding, errors="replace", newline="")
                    try:
                        rows += [(name, i, column) for i, column in enumerate(cells(lines, delimiter, quote, header_row))]
                    except ValueError as error:
                        raise ValueError(f"{key}: {error}") from None
            yield pd.DataFrame(rows, columns=["file", "position", "column_name"])

    listing = list_csv_files(spark, folder).select("name", "key").repartition("key")
    found = listing.mapInPandas(heads, "file string, position int, column_name string")
    return found.withColumn("data_type", F.lit("string"))


def read_csv(
    spark: SparkSession, path: str | Sequence[str], *, delimiter: str = DELIMITER, quote: str = QUOTE,
    header_row: int = 1, encoding: str = ENCODING, schema: T.StructType | str | None = None,
    multiline: bool = False, malformed: str | None = None,
) -> DataFrame:
    """A CSV file, or files of one layout. Without a schema every column is a string, and a file whose
    header differs from the others' is an error; a schema says what the columns are, whatever the
    headers. ``malformed`` adds a column of that name with the text of records that have more or fewer
    cells than there are columns.

    Files are split over tasks, but those in UTF-16 and UTF-32 with a header below line 1 are one row each.
    ``multiline`` is for quoted cells with line breaks; it reads each file in one task, so it suits small
    files only.
    """
    _check_options(delimiter, quote, header_row)
    path = path if isinstance(path, str) else list(path)
    if header_row > 1:
        return _read_below(spark, path, delimiter, quote, header_row, encoding, schema, malformed)

    def reader(**options):
        return (spark.read.options(header=True, sep=delimiter, quote=quote, escape=quote, encoding=_charset(encoding),
                                   multiLine=multiline, enforceSchema=True).options(**options))

    options = {}
    if schema is None:
        schema = reader().csv(path).schema
        cells = reader(header=False).csv(path).first()
        if cells is not None and _all_named([c or "" for c in cells]):
            options["enforceSchema"] = False  # Spark compares every file's header with these names
        elif cells is not None:  # it has made up names, so the headers themselves are compared
            lines = _lines(spark, path, encoding).filter(F.trim("value") != "")
            _header_of_all(lines, 1, delimiter, quote)
    schema = _with_malformed(_struct(schema), malformed)
    if malformed:
        options["columnNameOfCorruptRecord"] = malformed
    df = reader(**options).schema(schema).csv(path)
    return df.toDF(*[name.strip() or f"_c{i}" for i, name in enumerate(df.columns)])


def _all_named(cells: Sequence[str]) -> bool:
    """Whether no header cell is blank or occurs twice."""
    return all(c.strip() for c in cells) and len({c.lower() for c in cells}) == len(cells)


def _struct(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _with_malformed(schema: T.StructType, malformed: str | None) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(malformed, T.StringType())]) if malformed else schema


# The encodings that Spark decodes from bytes.
DECODED = ("utf-8", "us-ascii", "iso-8859-1", "utf-16", "utf-16le", "utf-16be", "utf-32")


def _lines(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """(value, file, at): every line of the files. ``file`` is the path for the lines of the block that
    starts a file and NULL for the others; ``at`` rises from line to line within a block.

    Wide encodings cannot be split at line ends by their bytes, so such a file is read as one row.
    """
    charset = _charset(encoding)
    wide = charset.startswith(("utf-16", "utf-32"))
    if wide:
        whole = F.decode("content", charset.upper())
        return (spark.read.format("binaryFile").load(path)
                .select(F.col("path").alias("file"), F.posexplode(F.split(whole, "\r\n|\r|\n")).alias("at", "value")))
    text, value = spark.read.text(path), F.col("value")
    if charset in DECODED[1:]:
        value = F.decode(value.cast("binary"), charset.upper())
    starts_file = F.col("_metadata.file_block_start") == 0
    return text.select(value.alias("value"), F.when(starts_file, F.col("_metadata.file_path")).alias("file"),
                       F.monotonically_increasing_id().alias("at"))


def _numbered(lines: DataFrame) -> DataFrame:
    """``lines`` with their number in the file, ``line``, from 0; NULL outside the block that starts it.

    A file's first line is the least of its first block, one row per file, which is broadcast: the
    driver has listed all these files already.
    """
    begins = lines.filter("file is not null").groupBy("file").agg(F.min("at").alias("begin"))
    return lines.join(F.broadcast(begins), "file", "left").withColumn("line", F.col("at") - F.col("begin"))


def _header_of_all(lines: DataFrame, header_row: int, delimiter: str, quote: str) -> list[str]:
    """The column names in that line of every file; a file that lacks it or has others is an error.

    The driver gets one header, and one of those that differ.
    """
    firsts = _numbered(lines).filter(F.col("line") < header_row).groupBy("file").agg(
        F.max_by("value", "line").alias("value"), F.max("line").alias("line")).persist()
    try:
        short = firsts.filter(F.col("line") < header_row - 1).first()
        head = firsts.orderBy("file").first()
        if head is None or short is not None:
            raise ValueError(f"{short['file'] if short else 'the source'} has no row {header_row}")
        names = header_names(head["value"], delimiter, quote)
        cells = F.from_csv(F.regexp_replace("value", "^\ufeff", ""), F.lit(", ".join(f"_{i} string" for i in range(len(names) + 1))),
                           {"sep": delimiter, "quote": quote, "escape": quote})
        trimmed = [F.coalesce(F.nullif(F.regexp_replace(cells[f"_{i}"], r"^\s+|\s+$", ""), F.lit("")), F.lit(f"_c{i}"))
                   for i in range(len(names))]
        same = F.array(*trimmed) == F.array(*[F.lit(n) for n in names])
        other = firsts.filter(~same | cells[f"_{len(names)}"].isNotNull()).first()
        if other is not None:
            raise ValueError(f"{other['file']}: its header is {other['value']!r}, that of {head['file']} is {head['value']!r}")
    finally:
        firsts.unpersist()
    return names


def _read_below(spark, path, delimiter, quote, header_row, encoding, schema, malformed) -> DataFrame:
    """Rows below a header that is not line 1: the lines are numbered by file, those down to the header
    are dropped and the others parsed."""
    if _charset(encoding) not in DECODED:
        raise ValueError(f"header_row above 1 needs one of the encodings {', '.join(DECODED)}")
    lines = _lines(spark, path, encoding)
    if schema is None:
        names = _header_of_all(lines, header_row, delimiter, quote)
        count = Counter(n.lower() for n in names)
        names = [n if count[n.lower()] == 1 else f"{n}{i}" for i, n in enumerate(names)]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    options = {"sep": delimiter, "quote": quote, "escape": quote}
    if malformed:
        options["columnNameOfCorruptRecord"] = malformed
    parsed = F.from_csv("value", _ddl(_with_malformed(_struct(schema), malformed)), options)
    below = F.col("line").isNull() | (F.col("line") >= header_row)
    return (_numbered(lines).filter(below & (F.col("value") != "")).select(parsed.alias("r")).select("r.*"))


def _ddl(schema: T.StructType) -> Column:
    return F.lit(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields))


def csv_types(df: DataFrame) -> DataFrame:
    """A type hint per column of an all-string frame, from all rows in one pass.

    (position, column_name, filled, suggested): the narrowest of BIGINT, DECIMAL, DATE, DATETIME that every
    non-blank value fits, else TEXT; a column without values is TEXT.
    """
    counts = []
    for i, name in enumerate(df.columns):
        text = F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))
        tests = {
            "filled": text.isNotNull(),
            "BIGINT": text.rlike(INTEGER_PATTERN) & text.try_cast("bigint").isNotNull(),
            "DECIMAL": text.rlike(NUMBER_PATTERN),
            "DATE": text.rlike(DATE_PATTERN) & text.try_cast("date").isNotNull(),
            "DATETIME": text.rlike(DATETIME_PATTERN) & text.try_cast("timestamp_ntz").isNotNull(),
        }
        counts += [F.count_if(test).alias(f"{kind}_{i}") for kind, test in tests.items()]
    one = df.agg(*counts)
    hints = []
    for i, name in enumerate(df.columns):
        filled = F.col(f"filled_{i}")
        hint = F.when(filled == 0, "TEXT")
        for kind in ("BIGINT", "DECIMAL", "DATE", "DATETIME"):
            hint = hint.when(F.col(f"{kind}_{i}") == filled, kind)
        hints.append(F.struct(F.lit(i).alias("position"), F.lit(name).alias("column_name"),
                              filled.alias("filled"), hint.otherwise("TEXT").alias("suggested")))
    return one.select(F.explode(F.array(*hints)).alias("h")).select("h.*")
