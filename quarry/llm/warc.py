"""WARC archives: written by Spark's text writer, read by a Python data source.

The reader plans one partition per archive file. It takes over predicates on header columns
(record type, target, digest, ...), parses each record's headers first, and seeks past the block
of a record that they rule out, so unwanted payloads are neither read nor decoded.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, IsNull,
                                    StringContains, StringEndsWith, StringStartsWith)

from quarry.llm.folders import open_folder
from quarry.plans.sizing import bounded_broadcast
from quarry.session import scratch_path

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = "urn:page:"
#: column -> header
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
           "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type",
           "payload_length": "x-payload-length"}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", content_length long, payload binary, payload_sha1 string"


def base32_sha1(text) -> object:
    """Bare upper-case base32 SHA-1 of a string column's UTF-8, in column functions."""
    bits = lambda i: F.conv(F.substring(F.sha1(text.cast("binary")), 5 * i + 1, 5), 16, 10).cast("int")
    signs = F.lit(ALPHABET)
    return F.concat(*(signs.substr(F.shiftright(bits(i), 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for i in range(8) for k in range(4)))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One record per row into archive files under ``path``.

    Of rows with equal payloads of at least ``min_bytes`` bytes that with the largest id is a
    response and the others are revisits that refer to it; shorter payloads are all responses.
    Null html is an empty payload, a null url an empty target. Rows that repeat the largest id are
    all responses; a row without id is a response only if no equal payload has one.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html"))).withColumn("bytes", F.octet_length("html").cast("long"))
    twice = (rows.filter(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.max("id").alias("kept"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1 and kept is not null").drop("n"))
    rows = rows.join(bounded_broadcast(twice), ["digest", "bytes"], "left")
    again = F.coalesce(~F.col("kept").eqNullSafe(F.col("id")) & F.col("kept").isNotNull(), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit("\r\n\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    named = lambda c: F.concat(F.lit(f"<{RECORD}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), named(F.col("id")),
        F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", "%0A"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.col("bytes"),
        F.when(again, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), named(F.col("kept")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit("\r\n\r\n"), block)
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)  # the two line ends that close a record


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


_TESTS = {EqualTo: lambda v, f: v == f.value, EqualNullSafe: lambda v, f: v == f.value, In: lambda v, f: v in f.value, IsNull: lambda v, f: v is None,
          IsNotNull: lambda v, f: v is not None, StringStartsWith: lambda v, f: v.startswith(f.value), StringEndsWith: lambda v, f: v.endswith(f.value),
          StringContains: lambda v, f: f.value in v}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.tests: list = []

    def pushFilters(self, filters):
        """Takes the filters on header columns; hands the others back."""
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append(f)
            else:
                yield f

    def partitions(self):
        files, root = open_folder(self.path)
        found = files.get_file_info(pafs.FileSelector(root, recursive=True)) if files.get_file_info(root).type == pafs.FileType.Directory else [files.get_file_info(root)]
        return [_File(x.path) for x in sorted(found, key=lambda x: x.path) if x.type == pafs.FileType.File and x.size and not x.base_name.startswith(("_", "."))]

    def _wanted(self, row: dict) -> bool:
        for f in self.tests:
            v = row[f.attribute[0]]
            if v is None and not isinstance(f, (EqualNullSafe, IsNull)) or not _TESTS[type(f)](v, f):
                return False
        return True

    def records(self, stream):
        """Rows of an uncompressed archive: headers first, the block only if it is wanted."""
        size = stream.size()
        buf, base, at = b"", 0, 0  # buf holds the bytes from base on

        def need(until: int):
            nonlocal buf, base
            if until > base + len(buf) or at < base:
                if at >= base + len(buf) or at < base:
                    stream.seek(at)
                    buf, base = b"", at
                else:
                    buf, base = buf[at - base :], at
                buf += stream.read(max(until - base - len(buf), 1 << 20))

        while at < size:
            need(min(at + 4096, size))
            while (end := buf.find(b"\r\n\r\n", at - base)) < 0 and base + len(buf) < size:
                need(base + len(buf) + 4096)
            if end < 0:
                raise ValueError(f"{self.path}: a record header at byte {at} has no end")
            head = dict.fromkeys(HEADERS.values())
            lines = buf[at - base : end].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"{self.path}: no record at byte {at}")
            for line in lines[1:]:
                name, _, value = line.partition(":")
                head[name.strip().lower()] = value.strip()
            length = int(head.get("content-length") or 0)
            block = base + end + 4
            row = {c: head[h] for c, h in HEADERS.items()} | {"content_length": length, "payload": None, "payload_sha1": None}
            at = block
            if self._wanted(row):
                if (self.payload or self.verify) and row["record_type"] == "response":
                    need(block + length)
                    body = buf[block - base : block - base + length].partition(b"\r\n\r\n")[2]
                    row["payload"] = body if self.payload else None
                    if self.verify:
                        row["payload_sha1"] = base64.b32encode(hashlib.sha1(body).digest()).decode()
                yield row
            at = block + length + 4

    def read(self, partition):
        if partition is None:  # there are no files
            return
        files, _ = open_folder(self.path)
        schema = pa.schema([*((c, pa.string()) for c in HEADERS), ("content_length", pa.int64()), ("payload", pa.binary()), ("payload_sha1", pa.string())])
        with files.open_input_file(partition.path) as stream:
            held, size = [], 0
            for row in self.records(stream):
                held.append(row)
                size += len(row["payload"] or b"") + 500
                if size > 1 << 24:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)``; options ``payload`` (false: null payloads) and ``verify`` (payload_sha1 of responses)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read_archive(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """Records of the archive files under ``path`` (a folder that executors share, or a file)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload)).option("verify", str(verify)).load(path)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri.

    A response's digest is that of the payload read back; a revisit has no payload and names its response's.
    An empty table gives an empty table. See ``write_archive`` for nulls and ties.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archive(pages, path, min_bytes)
    number = lambda c: F.regexp_extract(c, rf"^<{RECORD}(-?\d+)>$", 1)
    back = read_archive(spark, path, payload=False, verify=True).filter(F.col("record_type").isin("response", "revisit"))
    as_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return back.select(as_id("record_id").alias("page_id"), F.col("payload_length").cast("long").alias("payload_bytes"),
                       F.coalesce("payload_sha1", F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
                       "record_type", as_id("refers_to").alias("refers_to"), "target_uri")
