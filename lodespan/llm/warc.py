"""WARC archives: written by Spark's text writer, read by a Python data source.

A record is `WARC/1.1` header lines, an empty line, the block, and two line ends. The text writer's rows are records
without these two line ends, which are its line separator, so archives land in any file system that Spark writes to.

The reader plans one partition per archive file, or per group of small ones, and takes from the pushed-down filters what
concerns headers: record types and any header column compared with constants. It parses a record's header first, steps
over the payload of records the filters exclude without decoding it, and reads no payload at all where the `payload`
column is not asked for.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not, StringContains, StringEndsWith, StringStartsWith

from lodespan.session import cut, make_importable, scratch

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Archives up to this many bytes share a partition with others.
TOGETHER = 32 << 20

#: Columns and the headers they come from; `headers` has all of them in lower case, `payload` the block.
COLUMNS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "content_type": "content-type",
}
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS) + ", content_length long, headers map<string,string>, payload binary"


def base32(digest: Column) -> Column:
    """RFC 4648 base 32 of a binary whose length is a multiple of 5 bytes; null stays null."""
    alphabet, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    text = F.hex(digest)
    groups = F.sequence(F.lit(1), F.length(text), F.lit(10))  # 5 bytes are 10 hexadecimal and 8 base-32 digits
    return F.translate(F.array_join(F.transform(groups, lambda at: F.lpad(F.conv(F.substring(text, at, F.lit(10)), 16, 32), 8, "0")), ""), digits, alphabet)


def payload_digest(payload: Column) -> Column:
    """SHA-1 of a binary in upper-case base 32, without a prefix."""
    return base32(F.unhex(F.sha1(payload)))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null; line ends in a value become spaces."""
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(value, "[\r\n]+", " "), F.lit("\r\n"))).otherwise(F.lit(""))


def records(df: DataFrame, key: str, uri: str, payload: str, id_prefix: str = "urn:record:", date: str = "1970-01-01T00:00:00Z", least: int = 0) -> DataFrame:
    """One record a row: key, record_type, refers_to (a key), payload_digest, payload_bytes and record (binary).

    Of rows with equal payloads of at least `least` bytes, the one with the smallest key is a response and the others
    are revisits of it; smaller payloads are all responses. Equality is that of length and SHA-1. Null payloads are
    empty ones. Rows that repeat a key are told apart by nothing: with equal payloads, all rows with the smallest key are
    responses. Rows with a null key are revisits if any row with a key has their payload. Other columns are left out.
    """
    block = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = df.select(F.col(key).alias("key"), F.col(uri).cast("string").alias("uri"), block.alias("block"))
    rows = rows.select("*", payload_digest(F.col("block")).alias("payload_digest"), F.octet_length("block").cast("long").alias("payload_bytes"))
    # Groups of equal payloads can hold a third of all rows: their smallest keys are partial aggregates, joined back.
    firsts = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    # Cut, so that its size is known: a small table is broadcast, beside a large one hot payloads are split.
    firsts = cut(firsts.where("n > 1").select(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), "first"), "firsts")
    joined = rows.join(firsts, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left")
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    typed = joined.select("key", "uri", "block", "payload_digest", "payload_bytes", F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))
    name = lambda c: F.concat(F.lit(f"<{id_prefix}"), c.cast("string"), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("block"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", name(F.coalesce(F.col("key").cast("string"), F.lit("null")))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("uri")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        _line("WARC-Refers-To", name(F.col("refers_to"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("Content-Type", F.lit("text/html")),
        _line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    )
    return typed.select("key", "record_type", "refers_to", "payload_digest", "payload_bytes", F.concat(head.cast("binary"), body).alias("record"))


def write(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Writes the column record of df, one archive file for each partition; compression may be gzip.

    A row's bytes go out as they are: the cast to a text changes nothing and the writer adds the two line ends.
    """
    rows = df.select(F.col("record").cast("string").alias("value"))
    writer = rows.write.option("lineSep", END)
    (writer.option("compression", compression) if compression else writer).text(path)


# ---- reading


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def parse_header(stream: io.BufferedIOBase) -> dict[str, str] | None:
    """The header of the record at which the stream stands, names in lower case; None at the end of the archive.

    Empty lines before a record are skipped. Continued lines are joined by a space. Of a repeated header the last counts.
    """
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record here: {line[:40]!r}")
    headers: dict[str, str] = {}
    name = ""
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and name:
            headers[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        headers[name] = value.strip()
    return headers


@dataclass
class Archive(InputPartition):
    """Archive files of one partition."""

    paths: list[str] = field(default_factory=list)

    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


def _test(condition: Filter, value: str | None) -> bool | None:
    """Whether a header's value meets a filter; None (unknown) for a null but where the filter is about nulls."""
    if isinstance(condition, IsNull):
        return value is None
    if isinstance(condition, IsNotNull):
        return value is not None
    if isinstance(condition, Not):
        known = _test(condition.child, value)
        return None if known is None else not known
    if value is None:
        return None
    if isinstance(condition, EqualTo):
        return value == condition.value
    if isinstance(condition, In):
        return value in condition.value
    if isinstance(condition, StringStartsWith):
        return value.startswith(condition.value)
    if isinstance(condition, StringEndsWith):
        return value.endswith(condition.value)
    return condition.value in value


def _column(condition: Filter) -> str | None:
    """The header column that a filter is about; None for filters that aren't decided from headers."""
    if isinstance(condition, Not):
        return _column(condition.child)
    if isinstance(condition, (EqualTo, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains)) and len(condition.attribute) == 1 and condition.attribute[0] in COLUMNS:
        values = condition.value if isinstance(condition, In) else (getattr(condition, "value", ""),)
        return condition.attribute[0] if all(isinstance(v, str) for v in values) else None
    return None


class WarcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.names = [f.name for f in schema.fields]
        self.path, self.together = options["path"], int(options.get("together", TOGETHER))
        self.conditions: list[tuple[str, Filter]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for condition in filters:
            column = _column(condition)
            if column:
                self.conditions.append((column, condition))
            else:
                yield condition

    def partitions(self) -> list[Archive]:
        system, root = _filesystem(self.path)
        found = system.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.is_file else [x for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and not x.base_name.startswith(("_", "."))]
        plan: list[Archive] = []
        held: list[str] = []
        size = 0
        for file in sorted(files, key=lambda x: x.path):
            if held and size + file.size > self.together:
                plan.append(Archive(held))
                held, size = [], 0
            held.append(file.path)
            size += file.size
        return [*plan, *([Archive(held)] if held else [])]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as source:
                stream = io.BufferedReader(_Raw(source), 1 << 20) if not path.endswith(".gz") else gzip.GzipFile(fileobj=io.BufferedReader(_Raw(source), 1 << 20))
                for row, weight in self._records(stream):
                    rows.append(row)
                    size += weight
                    if len(rows) >= 1000 or size > 8 << 20:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _records(self, stream: io.BufferedIOBase) -> Iterator[tuple[tuple, int]]:
        wanted = "payload" in self.names
        while (headers := parse_header(stream)) is not None:
            length = int(headers.get("content-length", 0))
            kept = all(_test(c, headers.get(COLUMNS[column])) for column, c in self.conditions)
            payload = stream.read(length) if kept and wanted else None
            if payload is None:
                _skip(stream, length)
            elif len(payload) < length:
                raise ValueError("the archive ends within a record")
            if kept:
                values = {c: headers.get(h) for c, h in COLUMNS.items()} | {"content_length": length, "headers": list(headers.items()), "payload": payload}
                yield tuple(values[n] for n in self.names), length + 500

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"content_length": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
        columns = [pa.array(values, kinds.get(n, pa.string())) for n, values in zip(self.names, zip(*rows, strict=True), strict=True)]
        return pa.RecordBatch.from_arrays(columns, self.names)


def _skip(stream: io.BufferedIOBase, length: int) -> None:
    if isinstance(stream, io.BufferedReader):
        stream.seek(length, io.SEEK_CUR)
        return
    while length > 0 and (part := stream.read(min(length, 1 << 20))):
        length -= len(part)


class _Raw(io.RawIOBase):
    """An input file of pyarrow as Python's raw stream, so that lines can be read through a buffer."""

    def __init__(self, source: pa.NativeFile):
        self.source = source

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.source.seek(offset, whence)
        return self.source.tell()

    def tell(self) -> int:
        return self.source.tell()

    def readinto(self, buffer) -> int:
        data = self.source.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


class WarcSource(DataSource):
    """Format `warc`: options path, a file or a folder of archives (plain or .gz), and together, bytes of a partition.

    The schema's columns may be any part of SCHEMA, in any order. An empty folder gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))


def read(spark: SparkSession, path: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    """The records of the archives under path, with these columns of SCHEMA (all if None)."""
    make_importable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    full = T._parse_datatype_string(SCHEMA)
    schema = T.StructType([full[c] for c in columns]) if columns else full
    return spark.read.format("warc").schema(schema).options(**options).load(path)


def digests(df: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page, from archives written and read back.

    A response's size and digest are those of the payload read; a revisit has none, its header names both.
    """
    spark = df.sparkSession
    path = scratch(spark, "warc")
    write(records(df, "page_id", "url", "html"), path)
    back = read(spark, path, ["record_type", "record_id", "payload_digest", "refers_to", "headers", "payload"])
    number = lambda c: F.regexp_extract(c, ":([0-9-]+)>$", 1).try_cast("long")
    response = F.col("record_type") == "response"
    return back.select(
        number(F.col("record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.element_at("headers", "warc-payload-length").cast("long")).cast("long").alias("payload_bytes"),
        F.when(response, payload_digest(F.col("payload"))).otherwise(F.replace(F.col("payload_digest"), F.lit("sha1:"), F.lit(""))).alias("payload_digest"),
        "record_type",
        F.when(~response, number(F.col("refers_to"))).alias("refers_to"),
    )


#: DuckDB SQL of `digests`: its SHA-1 is hexadecimal, so base 32 is spelled from eight groups of five hexadecimal digits.
SQL = r"""
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), judged AS (
  SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM hashed
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substring(h, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM judged
"""
