from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from lodespan.llm import warc


def pages(spark):
    rows = [(1, "http://a/1\r\nX: y", "<p>é</p>"), (2, None, "same"), (3, "http://a/3", "same"), (4, "http://a/4", None), (5, "http://a/5", ""), (6, "http://a/6", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\n"), (3, "http://a/3", "same")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("clash"))


def test_pages_against_brute_force(spark):
    got = sorted(map(tuple, warc.digests(pages(spark)).collect()), key=str)
    firsts, want = {}, []
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages(spark).collect()]
    for key, data in rows:
        firsts[data] = min(key, firsts.get(data, key))
    for key, data in rows:
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((key, len(data), digest, "response" if firsts[data] == key else "revisit", None if firsts[data] == key else firsts[data]))
    assert got == sorted(want, key=str)
    assert warc.digests(pages(spark).limit(0)).count() == 0


def test_smaller_payloads_are_all_responses(spark):
    made = warc.records(pages(spark), "page_id", "url", "html", least=5)
    assert {r["record_type"] for r in made.collect()} == {"response"}


@pytest.mark.parametrize("compression", [None, "gzip"])
def test_binary_payloads_survive(spark, tmp_path, compression):
    data = [bytes(range(256)) * 40, b"", b"\r\n\r\n", b"\xff\xfe\x00" * 7]
    df = spark.createDataFrame([(n, "u", bytearray(d)) for n, d in enumerate(data)], "k long, u string, p binary").repartition(2)
    path = f"file://{tmp_path}/w"
    warc.write(warc.records(df, "k", "u", "p"), path, compression)
    back = {r["record_id"]: bytes(r["payload"]) for r in warc.read(spark, path).collect()}
    assert back == {f"<urn:record:{n}>": d for n, d in enumerate(data)}
    assert warc.read(spark, path, together="1").rdd.getNumPartitions() >= 2


def test_filters_are_pushed_and_payloads_skipped(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write(warc.records(pages(spark), "page_id", "url", "html"), path)
    every = warc.read(spark, path, ["record_type", "target_uri", "payload_digest", "content_length"])
    assert every.where("record_type = 'revisit'").count() == 3
    assert every.where("target_uri = 'http://a/3' and record_type in ('revisit')").count() == 2
    assert every.where("target_uri is null").count() == 1
    assert every.where("not target_uri = 'http://a/3'").count() == 4  # a null is neither
    assert every.where("target_uri like 'http://a/%' and content_length > 5").count() == 2

    class Watched(warc.WarcReader):
        seen = []

        def _batch(self, rows):
            self.seen.extend(rows)
            return super()._batch(rows)

    reader = Watched(warc.T.StructType([warc.T.StructField("record_type", warc.T.StringType()), warc.T.StructField("payload", warc.T.BinaryType())]), {"path": str(tmp_path / "w")})
    rest = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("content_length",), 5)]))
    assert len(rest) == 1 and isinstance(rest[0].value, int)
    for part in reader.partitions():
        list(reader.read(part))
    assert Watched.seen == [("revisit", b"")] * 3


def test_headers_and_errors():
    stream = io.BytesIO(b"\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nA: b\r\n  c\r\nContent-Length: 2\r\n\r\nxy")
    assert warc.parse_header(stream) == {"warc-type": "response", "a": "b c", "content-length": "2"} and stream.read() == b"xy"
    assert warc.parse_header(io.BytesIO(b"\r\n")) is None
    with pytest.raises(ValueError, match="no WARC record"):
        warc.parse_header(io.BytesIO(b"HTTP/1.1 200\r\n"))


def test_members_of_gzip(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    assert [bytes(r["payload"]) for r in warc.read(spark, str(tmp_path / "x.warc.gz")).collect()] == [b"abc", b"abc"]
