from __future__ import annotations

import gzip

import pytest

from rowferry.llm import queries, warc
from rowferry.workspace import fresh_folder


def brute(rows):
    first, out = {}, []
    for key, _, html in rows:
        payload = (html or "").encode()
        order = (key is None, key or 0)
        if payload not in first or order < first[payload][0]:
            first[payload] = (order, key)
    done = set()
    for key, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (html or "").encode()
        whole = first[payload][1] == key and payload not in done
        done.add(payload) if whole else None
        out.append((key, len(payload), warc.digest(payload), "response" if whole else "revisit",
                    None if whole else first[payload][1]))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert rows_of(queries.QUERIES["op6_warc"](spark, sf)) == brute(pages)


def test_odd_pages(spark):
    tricky = "body\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc\n\nhttp://x 1.1.1.1 20240101000000 text/html 5\nhello"
    rows = [(1, "http://a/", "same"), (2, "http://b/ c\n", "same"), (3, None, None), (4, "http://d/", ""), (5, "ftp://e/", tricky),
            (6, "http://f/", tricky), (None, "http://g/", "same"), (None, "http://h/", "alone"), (2, "http://b/ c\n", "same"),
            (7, "http://i/ü", "ß€😀" * 9000), (0, "http://j/", "same")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, block string, id int").repartition(3)
    folder = fresh_folder(spark, "test")
    assert rows_of(warc.archived(df, folder, archive_bytes=2000)) == brute(rows)
    payloads = {r.id: bytes(r.payload).decode() for r in warc.read_warc(spark, f"{folder}/warc", payloads=True).collect()
                if r.record_type == "response" and r.id}
    assert payloads["0"] == "same" and payloads["5"] == tricky and payloads["7"] == "ß€😀" * 9000
    again = [tuple(r) for r in warc.read_arc(spark, f"{folder}/arc", blocks=False).select("version").distinct().collect()]
    assert sorted(again) == [(1,), (2,)]
    assert warc.archived(df.limit(0), fresh_folder(spark, "test")).count() == 0


def test_equal_pages_share_no_archive(spark):
    """20,000 equal pages without an id are dealt among the archives."""
    equal = spark.range(20_000, numPartitions=2).selectExpr("null as page_id", "'http://a/' as url", "'same page' as html")
    folder = fresh_folder(spark, "test")
    warc.write_arc(equal, f"{folder}/arc", archive_bytes=1_000_000)
    per_file = [r["count"] for r in warc.read_arc(spark, f"{folder}/arc", blocks=False).groupBy("file").count().collect()]
    assert sum(per_file) == 20_000 and len(per_file) == 11 and max(per_file) < 1.1 * 20_000 / 11


def test_legacy_files_of_both_versions(spark, tmp_path):
    body = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>1</p>"
    first = b"1 0 Alexa\nURL IP-address Archive-date Content-type Archive-length\n\n"
    one = (b"filedesc://old.arc 0.0.0.0 19970101000000 text/plain %d\n%s\n" % (len(first), first) +
           b"http://a.example/with space 10.0.0.1 19970102030405 text/html %d\n%s\n\n" % (len(body), body)
           + b"dns:a.example 10.0.0.2 199701020304 text/dns 9\nA 1.2.3.4\nhttp://b.example/ 10.0.0.3 19970102030406 text/html 99\ncut")
    two = warc.arc_opening(2, "new.arc", "20010101000000") + b"\n" + warc.arc_record(2, "http://c.example/", "10.0.0.4", "20010102030405", "text/html", body)
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "a.arc").write_bytes(one)
    (tmp_path / "arc" / "b.arc.gz").write_bytes(gzip.compress(two))
    folder = fresh_folder(spark, "test")
    warc.convert(spark, f"file://{tmp_path}/arc", f"{folder}/warc")
    rows = {r.url: r for r in warc.read_warc(spark, f"{folder}/warc", payloads=True).collect() if r.url}
    assert rows["http://a.example/with space"].date == "1997-01-02T03:04:05Z" and rows["http://a.example/with space"].record_type == "response"
    assert bytes(rows["dns:a.example"].payload) == b"A 1.2.3.4" and rows["dns:a.example"].record_type == "resource"
    assert rows["dns:a.example"].date == "1997-01-02T03:04:00Z" and bytes(rows["http://b.example/"].payload) == b"cut"
    assert rows["http://c.example/"].record_type == "revisit"
    assert rows["http://c.example/"].refers_to == rows["http://a.example/with space"].record_id
    assert rows["http://c.example/"].payload_digest == warc.digest(b"<p>1</p>")
    records = [f for p in spark.read.format("binaryFile").load(f"{folder}/warc").collect() for f, _ in warc.parse_warc(bytes(p.content))]
    assert any(f["WARC-Type"] == "warcinfo" for f in records)
    assert any(f.get("WARC-Truncated") for f in records) and any(f.get("WARC-IP-Address") == "10.0.0.1" for f in records)


def test_blanks_in_addresses_are_escaped_by_their_bytes():
    record = warc.arc_record(1, "http://a/ b\u2028c\td", "1.1.1.1", "20240101000000", "text/html", b"x")
    header, block = next(warc.parse_arc(record))[2:]
    assert header["URL"] == "http://a/%20b%E2%80%A8c%09d" and block == b"x"


def test_bad_archives_are_errors():
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"filedesc://x 0.0.0.0 1 text/plain 5\n1 0 x\nhttp://a no length\n"))
    with pytest.raises(ValueError):
        list(warc.parse_warc(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc"))
    with pytest.raises(ValueError):
        list(warc.parse_warc(b"junk"))
