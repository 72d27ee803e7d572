"""Conversion of legacy ARC archives to WARC, and readers and writers for both.

An ARC file starts with a ``filedesc://`` record that names its version. Records of version 1
have a header line of five fields, of version 2 one of ten; both end in a declared length,
and the block of that many bytes follows. Header lines are split from the right, so a
url with spaces in it does no harm. The converter gives each record what WARC asks for: an identifier made
from the record's own content (the same input gives the same identifier), the
14-digit date as a W3C timestamp, the type, and SHA-256 digests of block and payload.
Of records with equal payloads of at least ``least`` bytes the one with the smallest key
is kept as response; the others become revisit records that refer to it and
carry no payload.

Archives are written by Spark's text writer: a record is a row and the record's end is the line
separator, so the files are committed as any Spark output is and any
file system of the cluster will do. Every file is one partition and is read back in a stream.

Defined cases: a null payload is an empty one. A null url is written as ``-`` and comes back
as null; white space and controls in a url are percent-encoded. A record cut off at the end of a
file comes back with what is there and ``truncated`` true. Blank lines between
records are skipped; a header line that cannot be read raises, with file and place. Records without a
key take no part in the search for equal payloads. Repeated rows are records of their own; of two with the
same key and payload both are responses. Only the named columns are read. An empty
table gives an archive without records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtrail.session import materialize, scratch_path

LEAST = 100
DATE = "20240101000000"
KEY_HEADER = "X-Record-Key"
_RUN = 256
_ARC_FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: (
    "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length")}
_BLANK = re.compile(r"[\x00-\x20\x7f]")
_ARC_COLUMNS = (
    "url string, ip string, date string, content_type string, version int, key long, truncated boolean, digest string, "
    "payload_bytes long, block binary"
)
_WARC_COLUMNS = (
    "record_id string, record_type string, url string, date string, key long, payload_digest string, refers_to string, "
    "payload_bytes long, payload_ok boolean, truncated boolean, payload binary"
)


def _binary(rows: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])


def _write(records: DataFrame, path: str, end: str) -> None:
    """One row is one record; the cast keeps the bytes as they are."""
    text = records.select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def arc_record(url: str | None, block: bytes, version: int, date: str, content_type: str = "text/html", ip: str = "0.0.0.0") -> bytes:
    """Header line and block of one record, without the newline that ends it."""
    name = _BLANK.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "-"
    if version == 1:
        fields = [name, ip, date, content_type, str(len(block))]
    else:
        fields = [name, ip, date, content_type, "200", "-", "-", "0", "-", str(len(block))]
    return " ".join(fields).encode("utf-8", "surrogatepass") + b"\n" + block


def _file_record(version: int, date: str) -> bytes:
    block = f"{version} 0 archive\n{_ARC_FIELDS[version]}\n".encode()
    return arc_record("filedesc://archive.arc", block, version, date, "text/plain")


def write_arc(pages: DataFrame, path: str, key_column: str, url_column: str, payload_column: str, version: int = 2, date: str = DATE) -> None:
    """Write pages as ARC records, each with the HTTP headers a crawler would have kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _binary([_file_record(version, date)])
        for batch in batches:
            for lo in range(0, batch.num_rows, _RUN):
                rows = []
                for key, url, payload in zip(*(c.to_pylist() for c in batch.slice(lo, _RUN).columns), strict=True):
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload or b'')}\r\n"
                    head += "" if key is None else f"{KEY_HEADER}: {key}\r\n"
                    rows.append(arc_record(url, head.encode() + b"\r\n" + (payload or b""), version, date))
                yield _binary(rows)

    taken = pages.select(
        F.col(key_column).cast("long").alias("key"), F.col(url_column).alias("url"), F.col(payload_column).cast("binary").alias("payload")
    )
    _write(taken.mapInArrow(run, "record binary"), path, "\n")


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its blank line, and payload; a block that is no HTTP message is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    at = block.find(b"\r\n\r\n")
    return (block[: at + 4], block[at + 4 :]) if at >= 0 else (block, b"")


def _key(head: bytes) -> int | None:
    m = re.search(rb"(?mi)^" + KEY_HEADER.encode() + rb":[ \t]*(-?\d+)\r?$", head)
    return int(m[1]) if m else None


def arc_records(stream: io.BufferedIOBase, name: str = "") -> Iterator[tuple]:
    """(url, ip, date, content type, version, block, truncated) of each record but the file's own."""
    version = 1
    while line := stream.readline():
        if not line.strip():
            continue
        text = line.rstrip(b"\r\n").decode("utf-8", "surrogateescape")
        own = text.startswith("filedesc://")
        # the line of a file's own record has the fields of its version
        for fields in (text.rsplit(" ", 9), text.rsplit(" ", 4)) if own else (text.rsplit(" ", 9 if version == 2 else 4),):
            if len(fields) in (5, 10) and fields[-1].isdigit() and re.fullmatch(r"\d{14}", fields[2]):
                break
        else:
            raise ValueError(f"{name}: no ARC header line: {text[:200]!r}")
        size = int(fields[-1])
        block = stream.read(size)
        if own:
            version = 2 if block[:1] == b"2" else 1
            continue
        yield fields[0], fields[1], fields[2], fields[3], version, block, len(block) < size


def _opened(content: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content")


def read_arc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """Records of all ARC files below a path; without ``blocks`` only what describes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, held = [], 0
                for url, ip, date, kind, version, block, cut in arc_records(_opened(content.as_py()), name.as_py()):
                    head, payload = _split_http(block)
                    digest = hashlib.sha256(payload).hexdigest()
                    url = None if url == "-" else url.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
                    rows.append((url, ip, date, kind, version, _key(head), cut, digest, len(payload), block if blocks else None))
                    held += len(block)
                    if len(rows) == _RUN or held > 1 << 23:
                        yield _rows(rows, _ARC_COLUMNS)
                        rows, held = [], 0
                yield _rows(rows, _ARC_COLUMNS)

    return _files(spark, path).mapInArrow(run, _ARC_COLUMNS)


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _rows(rows: list[tuple], columns: str) -> pa.RecordBatch:
    names = [c.split() for c in columns.split(", ")]
    sides = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(s), _TYPES[k]) for s, (_, k) in zip(sides, names, strict=True)], [n for n, _ in names]
    )


def record_name(key: int | None, url: str | None, date: str, digest: str) -> str:
    """An identifier that follows from the record alone."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}|{url}|{date}|{digest}')}>"


def warc_date(date: str) -> str:
    """W3C form of a 14-digit date."""
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def _warc(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{n}: {v}" for n, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST) -> None:
    """Write the WARC equivalent of all ARC files below ``arc_path``."""
    index = read_arc(spark, arc_path, blocks=False).where(f"key IS NOT NULL AND payload_bytes >= {least}")
    many = index.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    named = index.join(many, "digest").where("key = first")
    firsts = named.groupBy("digest").agg(F.min("key").alias("first"), F.min(F.struct("url", "date")).alias("named"))
    firsts = materialize(firsts.select("digest", "first", F.col("named.url").alias("first_url"), F.col("named.date").alias("first_date")), "first-payloads")
    records = read_arc(spark, arc_path).join(firsts, "digest", "left").select(
        "url", "date", "content_type", "key", "digest", "payload_bytes", "block",
        F.expr(f"CASE WHEN key <> first AND payload_bytes >= {least} THEN first END").alias("first"), "first_url", "first_date",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = b"software: ARC converter\r\nformat: WARC File Format 1.1\r\n"
        fields = [("WARC-Type", "warcinfo"), ("WARC-Date", warc_date(DATE)), ("WARC-Record-ID", record_name(None, None, DATE, "info"))]
        yield _binary([_warc([*fields, ("Content-Type", "application/warc-fields")], info)])
        for batch in batches:
            for lo in range(0, batch.num_rows, _RUN):
                rows = []
                for row in zip(*(c.to_pylist() for c in batch.slice(lo, _RUN).columns), strict=True):
                    url, date, kind, key, digest, _, block, first, first_url, first_date = row
                    head, _ = _split_http(block)
                    if first is not None:
                        block = head
                    of_type = "revisit" if first is not None else "response" if head else "resource"
                    fields = [
                        ("WARC-Type", of_type),
                        ("WARC-Target-URI", url),
                        ("WARC-Date", warc_date(date)),
                        ("WARC-Record-ID", record_name(key, url, date, digest)),
                        ("WARC-Payload-Digest", f"sha256:{digest}"),
                        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
                        ("Content-Type", "application/http; msgtype=response" if head else kind),
                    ]
                    if first is not None:
                        fields += [
                            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                            ("WARC-Refers-To", record_name(first, first_url, first_date, digest)),
                        ]
                    rows.append(_warc(fields, block))
                yield _binary(rows)

    _write(records.mapInArrow(run, "record binary"), warc_path, "\r\n\r\n")


def warc_records(stream: io.BufferedIOBase, name: str = "") -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(fields with lower-case names, block, truncated) of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: no WARC version line: {line[:200]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            n, _, v = line.decode("utf-8", "surrogateescape").partition(":")
            fields[n.strip().lower()] = v.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        yield fields, block, len(block) < size


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all WARC files below a path but their own descriptions.

    ``payload_ok`` tells whether the payload has the digest the record declares; for a revisit it is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, held = [], 0
                for f, block, cut in warc_records(_opened(content.as_py()), name.as_py()):
                    if f["warc-type"] == "warcinfo":
                        continue
                    head, payload = _split_http(block)
                    digest = f.get("warc-payload-digest", "").removeprefix("sha256:")
                    revisit = f["warc-type"] == "revisit"
                    rows.append((
                        f["warc-record-id"], f["warc-type"], f.get("warc-target-uri"), f["warc-date"], _key(head), digest,
                        f.get("warc-refers-to"), None if revisit else len(payload),
                        None if revisit else hashlib.sha256(payload).hexdigest() == digest, cut,
                        payload if payloads and not revisit else None,
                    ))
                    held += len(block)
                    if len(rows) == _RUN or held > 1 << 23:
                        yield _rows(rows, _WARC_COLUMNS)
                        rows, held = [], 0
                yield _rows(rows, _WARC_COLUMNS)

    return _files(spark, path).mapInArrow(run, _WARC_COLUMNS)


def pages_through_archives(pages: DataFrame, key_column: str, url_column: str, payload_column: str, least: int = LEAST) -> DataFrame:
    """Write pages as ARC, convert them to WARC and read that back, revisits resolved to their responses."""
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc, key_column, url_column, payload_column)
    convert_arc(spark, arc, warc, least)
    back = materialize(read_warc(spark, warc, payloads=False).drop("payload"), "warc-index")
    whole = back.where("record_type <> 'revisit'").select(
        F.col("record_id").alias("refers_to"), F.col("key").alias("response_key"), F.col("payload_bytes").alias("response_bytes")
    )
    whole = whole.join(back.where("refers_to IS NOT NULL").select("refers_to").distinct(), "refers_to").distinct()
    return back.join(materialize(whole, "responses"), "refers_to", "left").select(
        F.col("key").alias(key_column), F.coalesce("payload_bytes", "response_bytes").alias("payload_bytes"), "payload_digest",
        "record_type", F.col("response_key").alias("refers_to"), "url", "record_id", "payload_ok",
    )
