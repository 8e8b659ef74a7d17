from __future__ import annotations

import os
import tempfile

import pytest

from queries import files
from rowferry.sources.csv_files import csv_columns, csv_types, header_names, list_csv_files, read_csv
from rowferry.sources.open import open_source
from rowferry.spec import Connection, Source


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def write(folder, name, text, encoding="utf-8"):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return path


def bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_header_names():
    assert header_names("id, name ,\n1,Alice,") == ["id", "name", "_c2"]
    assert header_names("a;b\n'x;y';z\n", ";", "'", 2) == ["x;y", "z"]
    for sample, row in (("", 1), (" \n", 1), (",,\n", 1), ("a,b\n", 2)):
        with pytest.raises(ValueError):
            header_names(sample, header_row=row)
    for bad in ({"delimiter": ";;"}, {"quote": ""}, {"header_row": 0}):
        with pytest.raises(ValueError):
            header_names("a\n", **bad)


def test_plain(spark, folder):
    path = write(folder, "a.csv", 'id, name ,\n1,Alice,x\n2,"B, ""b""",\n3,,\n')
    df = read_csv(spark, path)
    assert df.columns == ["id", "name", "_c2"] and {t for _, t in df.dtypes} == {"string"}
    assert bag(df) == [("1", "Alice", "x"), ("2", 'B, "b"', None), ("3", None, None)]


def test_several_files_and_schema(spark, folder):
    for i in range(3):
        write(folder, f"{i}.csv", f"id,v\n{i},{i}.5\n")
    assert bag(read_csv(spark, folder, schema="id int, v double")) == [(0, 0.5), (1, 1.5), (2, 2.5)]


def test_encoding(spark, folder):
    path = write(folder, "a.csv", "id;name\n1;Zoë\n", "latin-1")
    assert bag(read_csv(spark, path, delimiter=";", encoding="latin-1")) == [("1", "Zoë")]


@pytest.mark.parametrize("row", [2, 3])
def test_header_row(spark, folder, row):
    for name, n in (("a.csv", 5), ("b.csv", 0), ("c.csv", 40)):
        head = "".join(f"remark {i}; x\n" for i in range(row - 1)) + " id ;'na;me'\n"
        write(folder, name, head + "".join(f"{name}{i};'v;{i}'\n" for i in range(n)))
    df = read_csv(spark, folder, delimiter=";", quote="'", header_row=row)
    assert df.columns == ["id", "na;me"]
    wanted = [(f"{name}{i}", f"v;{i}") for name, n in (("a.csv", 5), ("c.csv", 40)) for i in range(n)]
    assert bag(df) == sorted(wanted, key=repr)


def test_header_row_of_a_split_file(spark, folder):
    """Only the first split of a file has header lines."""
    write(folder, "a.csv", "x\nid,v\n" + "".join(f"{i},{'z' * 50}\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = read_csv(spark, folder, header_row=2)
        assert df.rdd.getNumPartitions() > 5
        assert sorted(int(r.id) for r in df.collect()) == list(range(2000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_breaks_in_cells(spark, folder):
    path = write(folder, "a.csv", 'id,t\n1,"a\nb"\n2,c\n')
    assert bag(read_csv(spark, path, multiline=True)) == [("1", "a\nb"), ("2", "c")]


def test_listing(spark, folder):
    write(folder, "b.CSV", "x\n"), write(folder, "sub/A.csv", "xy\n"), write(folder, "c.txt", "no\n")
    got = list_csv_files(spark, folder).collect()
    assert [r.name for r in got] == ["A.csv", "b.CSV"]
    assert [r.size for r in got] == [3, 2] and got[0].key.endswith("sub/A.csv") and got[0].modified
    plan = list_csv_files(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_columns_of_many_files(spark, folder):
    write(folder, "a.csv", "id,name\n1,Alice\n"), write(folder, "sub/b.csv", "x, y ,\n")
    got = bag(csv_columns(spark, folder))
    assert got == [("a.csv", 0, "id", "string"), ("a.csv", 1, "name", "string"), ("b.csv", 0, "x", "string"),
                   ("b.csv", 1, "y", "string"), ("b.csv", 2, "_c2", "string")]
    write(folder, "empty.csv", "")
    with pytest.raises(Exception, match="empty"):
        csv_columns(spark, folder).collect()


def test_types(spark, folder):
    path = write(folder, "a.csv", "i,d,day,dt,t,none,big\n1,1.5,2024-1-2,2024-01-02 03:04:05,x,,99999999999999999999\n"
                                  "-2,3, 2024-02-29 ,,1,,1\n")
    got = {r.column_name: (r.filled, r.suggested) for r in csv_types(read_csv(spark, path)).collect()}
    assert got == {"i": (2, "BIGINT"), "d": (2, "DECIMAL"), "day": (2, "DATE"), "dt": (1, "DATETIME"), "t": (2, "TEXT"),
                   "none": (0, "TEXT"), "big": (2, "DECIMAL")}


def test_open_source(spark, folder):
    write(folder, "a.csv", "id;n\n1;x\n")
    places = {
        "bucket": Connection("CSV_S3_BUCKET", f"file:{folder}/"),
        "local": Connection("LOCAL_CSV", f"{folder}/a.csv", {"parse_options": {"delimiter": ";"}})}
    assert open_source(spark, Source("a", "bucket", "a.csv"), places).columns == ["id;n"]
    assert bag(open_source(spark, Source("a", "local", "a.csv"), places)) == [("1", "x")]


def test_long_headers_marks_and_quoted_breaks(spark, tmp_path):
    wide = [f"column_number_{i:05d}" for i in range(5000)]
    (tmp_path / "wide.csv").write_text("﻿" + ",".join(wide) + "\n1\n", encoding="utf-8")
    (tmp_path / "broken.csv").write_text('"a\nb",c\n1,2\n', encoding="utf-8")
    rows = csv_columns(spark, str(tmp_path)).orderBy("file", "position").collect()
    assert [r.column_name for r in rows if r.file == "wide.csv"] == wide
    assert [r.column_name for r in rows if r.file == "broken.csv"] == ["a\nb", "c"]


def test_headers_that_differ_and_records_of_another_width(spark, folder):
    write(folder, "m/a.csv", "id,name\n1,x,more\n2\n3,y\n")
    got = bag(read_csv(spark, f"{folder}/m", malformed="record"))
    assert got == [("1", "x", "1,x,more"), ("2", None, "2"), ("3", "y", None)]
    below = write(folder, "n/a.csv", "remark\nid,name\n1,x,more\n3,y\n")
    assert bag(read_csv(spark, below, header_row=2, malformed="record")) == [("1", "x", "1,x,more"), ("3", "y", None)]
    write(folder, "o/a.csv", "id,name\n1,x\n"), write(folder, "o/b.csv", "name,id\ny,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, f"{folder}/o").collect()


@pytest.mark.parametrize("heads", [("a0,b", "b,a0"), ("id,line1", "line1,id"), ("a,,b1", "b1,,a"), ("a,a,c", "a,c,a"), ("id,b", "id,c"), ("a,b", "a,b,c")])
@pytest.mark.parametrize("row", [1, 3])
def test_other_headers_are_refused(spark, folder, heads, row):
    """Whatever the names look like, and wherever the header stands."""
    for i, head in enumerate(heads):
        write(folder, f"{i}.csv", "remark\n" * (row - 1) + f"{head}\nx,{i},z\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, folder, header_row=row).collect()


@pytest.mark.parametrize("row", [1, 2])
def test_equal_headers_with_made_up_names(spark, folder, row):
    for i, head in enumerate(("id,,v1,v1", 'id, ,"v1",v1')):
        write(folder, f"{i}.csv", "remark\n" * (row - 1) + f"{head}\n{i},a,b,c\n")
    df = read_csv(spark, folder, header_row=row)
    assert df.columns == ["id", "_c1", "v12", "v13"] and bag(df) == [("0", "a", "b", "c"), ("1", "a", "b", "c")]


def test_a_file_without_the_header_row(spark, folder):
    write(folder, "a.csv", "remark\nid,v\n1,2\n")
    write(folder, "b.csv", "remark\n")
    with pytest.raises(ValueError, match="b.csv has no row 2"):
        read_csv(spark, folder, header_row=2)
    assert bag(read_csv(spark, folder, header_row=2, schema="id int, v int")) == [(1, 2)]


@pytest.mark.parametrize("encoding", ["utf-16", "utf-16-le", "utf-16-be", "latin-1", "utf-8", "ascii"])
def test_header_below_line_1_in_any_encoding(spark, folder, encoding):
    name = "Zo\xeb āਊ" if encoding.startswith("utf") else "Zoe" if encoding == "ascii" else "Zo\xeb"
    for i, end in enumerate(("\n", "\r\n")):
        write(folder, f"{i}.csv", end.join(["remark; \xe4" if encoding != "ascii" else "remark", "id;name", f"{i};'{name}; x'", "", "8;"]), encoding)
    df = read_csv(spark, folder, delimiter=";", quote="'", header_row=2, encoding=encoding)
    assert bag(df) == sorted([("0", f"{name}; x"), ("1", f"{name}; x"), ("8", None), ("8", None)], key=repr)


def test_a_mark_of_the_byte_order_before_the_header(spark, folder):
    write(folder, "a.csv", "﻿remark\nid,v\n1,2\n")
    write(folder, "b.csv", "remark\n﻿id,v\n3,4\n")
    assert bag(read_csv(spark, folder, header_row=2)) == [("1", "2"), ("3", "4")]


def test_encodings_that_spark_does_not_decode(spark, folder):
    path = write(folder, "a.csv", "remark\nid,v\n1,€\n", "cp1252")
    with pytest.raises(ValueError, match="encodings"):
        read_csv(spark, path, header_row=2, encoding="cp1252")


def test_headers_are_listed_of_every_table_also_documents(spark, sf):
    """The query also lists the headers of documents, whose text column is written between blanks."""
    found = files.csv_columns_query(spark, sf)
    names = found.filter("name = 'documents'").orderBy("position").collect()
    assert [r["column_name"] for r in names] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_the_files_of_the_listing_are_written_by_many_tasks(spark, sf, monkeypatch):
    """No task gets all documents, however many files a language then has."""
    monkeypatch.setattr(files, "table", lambda spark, sf, name: spark.read.parquet(f"{sf}/{name}.parquet").repartition(5))
    found, listing = [], files.list_csv_files
    monkeypatch.setattr(files, "list_csv_files", lambda spark, folder: found.append(listing(spark, folder)) or found[0])
    rows = files.csv_files(spark, sf).collect()
    listed = found[0].collect()
    parts = {f["key"].rsplit("/", 1)[1].split("-c000")[0] for f in listed}
    assert len(parts) >= 5 and len(listed) > len(rows)
    assert sum(r["size"] for r in rows) == sum(f["size"] for f in listed)
    heads = [f for f in listed if f["size"] == len("doc_id,digest\n")]
    assert len(heads) == len(rows) == len({r["lang"] for r in rows}) and all(r["named"] and r["dated"] for r in rows)
