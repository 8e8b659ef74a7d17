"""Legacy ARC archives, and their conversion to WARC.

Archives are written by Spark's text sink, one record a row, with the separator of the format as line
separator, and read whole as binary files; so they live wherever Spark can write. ``archive_bytes``
bounds their size, and one archive at a time is in a task's memory.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowferry.llm.common import written

#: The line that names the header's fields, by version of the format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ID_HEADER = "X-Page-Id"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ARC_SEPARATOR, WARC_SEPARATOR = "\n", "\r\n\r\n"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ARC ------------------------------------------------------------------------------------------------

def arc_record(version: int, url: str, ip: str, date: str, mime: str, block: bytes, status: str = "200") -> bytes:
    """Header line and block. A version 2 line has the result code, a checksum and four places more."""
    url = re.sub(r"[\s\x00-\x1f]", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), url) or "-"
    middle = [] if version == 1 else [status, hashlib.md5(block).hexdigest(), "-", "0", "-"]
    return " ".join([url, ip, date, mime, *middle, str(len(block))]).encode("utf-8", "surrogatepass") + b"\n" + block


def arc_opening(version: int, name: str, date: str) -> bytes:
    """The record that opens a file: its block tells the version and the fields of the header lines."""
    block = f"{version} 0 rowferry\n{ARC_FIELDS[version]}\n".encode()
    return arc_record(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", block)


def parse_arc(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, version, header, block) of each record, the opening one included, gzipped or not.

    The first block names the version and the fields, by which later lines are read: from the right,
    since old addresses may hold spaces. Blocks are taken by their declared length; a block that the
    file cuts short is given as far as it goes.
    """
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    fields, version, at = ARC_FIELDS[1].split(), 1, 0
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].decode("utf-8", "surrogateescape").rstrip("\r")
        names = ARC_FIELDS[2 if line.count(" ") >= 9 else 1].split() if line.startswith("filedesc:") else fields
        values = line.rsplit(" ", len(names) - 1)
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"no ARC header at byte {at}: {line[:80]!r}")
        header = dict(zip(names, values))
        block = data[end + 1:end + 1 + int(values[-1])]
        if line.startswith("filedesc:"):
            first, _, rest = block.partition(b"\n")
            version = int(first.split(b" ")[0])
            fields = rest.split(b"\n")[0].decode().split() or ARC_FIELDS[version].split()
        yield at, version, header, block
        at = end + 1 + int(values[-1])


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head, with the empty line that ends it, and payload."""
    for gap in (b"\r\n\r\n", b"\n\n"):
        head, found, payload = block.partition(gap)
        if found:
            return head + gap, payload
    return block, b""


def http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^%s:[ \t]*([^\r\n]*)" % re.escape(name.encode()), head)
    return found.group(1).decode("utf-8", "replace").strip() if found else None


def write_arc(pages: DataFrame, path: str, *, id: str = "page_id", url: str = "url", html: str = "html",
              date: str = "20240101000000", archive_bytes: int = 16 << 20) -> None:
    """One ARC record for each row, its block an HTTP response with the page as payload. Every other
    file is of version 2. The id goes into a header of the response; a NULL one has none."""
    rows = pages.select(F.col(id).cast("string").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"),
                        F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8").alias("payload"))
    total = rows.agg(F.sum(F.octet_length("payload") + 500)).first()[0] or 0

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        version, opened = 1 + part % 2, False
        for batch in batches:
            out = [] if opened else [arc_opening(version, f"pages-{part:06d}.arc", date)]
            opened = True
            for key, address, payload in zip(batch["id"], batch["url"], batch["payload"]):
                named = "" if key is None else f"{ID_HEADER}: {key}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{named}\r\n"
                out.append(arc_record(version, address, "0.0.0.0", date, "text/html", head.encode() + bytes(payload)))
            yield pd.DataFrame({"record": out})

    archives = rows.repartition(max(1, -(-total // archive_bytes)))  # in turn, so that equal pages share no archive
    _write(archives.mapInPandas(records, "record binary"), path, ARC_SEPARATOR)


def _write(records: DataFrame, path: str, separator: str) -> None:
    (records.select(F.col("record").cast("string")).write.option("lineSep", separator)
     .option("compression", "gzip").text(path))


def read_arc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """The records of ARC files but their opening ones: (file, offset, version, url, ip, date, mime,
    truncated, id, length, payload_digest, payload_bytes[, block])."""
    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                out = []
                for offset, version, header, block in parse_arc(bytes(content)):
                    if header["URL"].startswith("filedesc:"):
                        continue
                    head, payload = split_http(block) if block.startswith(b"HTTP/") else (b"", block)
                    declared = int(header["Archive-length"])
                    row = (file, offset, version, header["URL"], header["IP-address"], header["Archive-date"],
                           header["Content-type"], len(block) < declared, http_field(head, ID_HEADER), len(block),
                           digest(payload), len(payload))
                    out.append((*row, block) if blocks else row)
                yield pd.DataFrame(out, columns=names)

    schema = ("file string, offset long, version int, url string, ip string, date string, mime string, truncated boolean, "
              "id string, length long, payload_digest string, payload_bytes long")
    schema += ", block binary" if blocks else ""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(records, schema)


# WARC -----------------------------------------------------------------------------------------------

def record_id(*parts: object) -> str:
    """The same identifier whenever the same record is converted again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(map(str, parts)))}>"


def warc_date(date: str) -> str:
    """ISO 8601 of a legacy date of 14 digits or fewer, the missing ones being the earliest."""
    digits = re.sub(r"\D", "", date)[:14]
    digits += "00000101000000"[len(digits):]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:]}Z"


def warc_record(fields: dict[str, str | None], block: bytes) -> bytes:
    """A record without the separator that follows it."""
    lines = [f"{k}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join(["WARC/1.0", *lines, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogateescape") + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record, by declared lengths, gzipped or not."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]
        fields = {k: v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length = int(fields["Content-Length"])
        block = data[end + 4:end + 4 + length]
        if len(block) < length:
            raise ValueError(f"WARC record at byte {at} is cut short")
        yield fields, block
        at = end + 4 + length + len(WARC_SEPARATOR)


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Convert ARC files into WARC files.

    Identifiers are made from file, offset, address, date and digest, dates from the legacy ones,
    types from address and block: HTTP answers are responses, others resources. Of the records with
    equal payloads that with the least page id, then file and offset, is written whole (NULL ids
    come last), the others as revisits of it without payload. Which is which is decided on a table
    without payloads, one row for each digest, combined before its shuffle.
    """
    index = written(read_arc(spark, arc_path, blocks=False), "arc-index")
    order = F.struct(F.col("id").isNull(), F.col("id").try_cast("decimal(38,0)"), "id", "file", "offset")
    first = index.groupBy("payload_digest").agg(F.min_by(F.struct("file", "offset", "url", "date"), order).alias("first"))
    decided = (index.join(first, "payload_digest")
               .where((F.col("file") != F.col("first.file")) | (F.col("offset") != F.col("first.offset")))
               .select("file", "offset", "first"))

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = False
        for batch in batches:
            out = []
            if not opened:
                info = b"software: rowferry\r\nformat: WARC File Format 1.0\r\nconversion: from ARC\r\n"
                out.append(warc_record({"WARC-Type": "warcinfo", "WARC-Date": warc_date(min(batch["date"])),
                                        "WARC-Record-ID": record_id("info", batch["file"].iloc[0], batch["offset"].iloc[0]),
                                        "Content-Type": "application/warc-fields"}, info))
                opened = True
            for row in batch.itertuples(index=False):
                out.append(_converted(row))
            yield pd.DataFrame({"record": out})

    whole = read_arc(spark, arc_path)
    _write(whole.join(decided, ["file", "offset"], "left").withColumns({
        "first_file": F.col("first.file"), "first_offset": F.col("first.offset").cast("string"),
        "first_url": F.col("first.url"), "first_date": F.col("first.date")}).drop("first")
        .mapInPandas(records, "record binary"), warc_path, WARC_SEPARATOR)


def _converted(row) -> bytes:
    block = bytes(row.block)
    http = block.startswith(b"HTTP/")
    revisit = row.first_file is not None
    fields = {
        "WARC-Type": "revisit" if revisit else "response" if http else "resource",
        "WARC-Record-ID": record_id(row.file, row.offset, row.url, row.date, row.payload_digest),
        "WARC-Date": warc_date(row.date),
        "WARC-Target-URI": row.url,
        "WARC-IP-Address": row.ip if row.ip not in ("0.0.0.0", "-", "") else None,
        "WARC-Payload-Digest": f"sha1:{row.payload_digest}",
        "WARC-Truncated": "unspecified" if row.truncated else None,
        "Content-Type": "application/http; msgtype=response" if http else row.mime,
    }
    if revisit:
        block = split_http(block)[0] if http else b""
        fields |= {
            "WARC-Profile": REVISIT_PROFILE,
            "WARC-Refers-To": record_id(row.first_file, int(row.first_offset), row.first_url, row.first_date, row.payload_digest),
            "WARC-Refers-To-Target-URI": row.first_url,
            "WARC-Refers-To-Date": warc_date(row.first_date),
        }
    fields["WARC-Block-Digest"] = f"sha1:{digest(block)}"
    return warc_record(fields, block)


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of WARC files: (record_type, record_id, refers_to, date, url, id, payload_bytes,
    payload_digest[, payload]). A revisit's length is that of the payload it leaves out; digests of
    payloads that are there are computed anew, and a wrong one fails."""
    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                out = []
                for fields, block in parse_warc(bytes(content)):
                    kind, known = fields["WARC-Type"], fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                    head, payload = split_http(block) if block.startswith(b"HTTP/") else (b"", block)
                    length: int | None = len(payload)
                    if kind == "revisit":
                        stated = http_field(head, "Content-Length")
                        length = int(stated) if stated else None
                    elif known and digest(payload) != known:
                        raise ValueError(f"wrong digest of {fields['WARC-Record-ID']}")
                    row = (kind, fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), fields.get("WARC-Date"),
                           fields.get("WARC-Target-URI"), http_field(head, ID_HEADER),
                           None if length is None else str(length), known or None)
                    out.append((*row, payload) if payloads else row)
                yield pd.DataFrame(out, columns=names)

    schema = ("record_type string, record_id string, refers_to string, date string, url string, id string, "
              "payload_bytes string, payload_digest string") + (", payload binary" if payloads else "")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return (spark.read.format("binaryFile").load(path).select("content").mapInPandas(records, schema)
            .withColumn("payload_bytes", F.col("payload_bytes").cast("long")))


def archived(pages: DataFrame, folder: str, *, id: str = "page_id", url: str = "url", html: str = "html",
             archive_bytes: int = 16 << 20) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every row of ``pages``, read
    from WARC files in ``folder``/warc that were converted from ARC files in ``folder``/arc.

    A NULL page is an empty payload. Repeated rows are records of their own; a row with a NULL id has
    a record without one, and is a response only where no other page has its payload. An empty table
    writes no record and gives no rows; other columns are not used.
    """
    spark = pages.sparkSession
    write_arc(pages, f"{folder}/arc", id=id, url=url, html=html, archive_bytes=archive_bytes)
    convert(spark, f"{folder}/arc", f"{folder}/warc")
    found = written(read_warc(spark, f"{folder}/warc").where("record_type <> 'warcinfo'"), "warc-index")
    known = found.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to"), F.col("id").alias("first_id"))
    kind = pages.schema[id].dataType
    return (found.join(known, "refers_to", "left")
            .select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                    F.col("first_id").cast(kind).alias("refers_to")))
