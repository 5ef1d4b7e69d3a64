"""Fetching addresses and one round of a crawl."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodespan.operators import frontier, pages
from lodespan.session import cut, make_importable

SUCCESS, RATE_LIMITED, ERROR = "success", "rate_limited", "error"


@dataclass
class Fetched:
    status: str
    content: bytes | None = None
    mime_type: str | None = None
    error: str | None = None


class Fetcher(Protocol):
    """Fetches one address; made once for each task by its factory."""

    def __call__(self, url: str) -> Fetched: ...


class HttpFetcher:
    """A plain GET: 429 is a rate limit, other codes outside 2xx and failures are errors; the media type is in lower case."""

    def __init__(self, agent: str = "lodespanbot", timeout_s: float = 20):
        self.agent, self.timeout_s = agent, timeout_s

    def __call__(self, url: str) -> Fetched:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": self.agent}), timeout=self.timeout_s) as answer:
                return Fetched(SUCCESS, answer.read(), (answer.headers.get("Content-Type") or "text/html").lower())
        except urllib.error.HTTPError as error:
            return Fetched(RATE_LIMITED) if error.code == 429 else Fetched(ERROR, error=f"status {error.code}")
        except (OSError, ValueError) as error:
            return Fetched(ERROR, error=str(error))


_RESULT = T.StructType([T.StructField("status", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("mime_type", T.StringType()), T.StructField("error", T.StringType())])
_ARROW = pa.struct([("status", pa.string()), ("content", pa.binary()), ("mime_type", pa.string()), ("error", pa.string())])


def fetch(urls: DataFrame, factory: Callable[[], Fetcher] = HttpFetcher, column: str = "url") -> DataFrame:
    """urls with status, content, mime_type and error of each address.

    Each domain's addresses are fetched by one task, in the order of start_s where there is one.
    """
    make_importable(urls.sparkSession)
    names = [c for c in urls.columns if c != "fetched"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetcher = factory()
        for whole in batches:
            for start in range(0, whole.num_rows, 50):
                batch = whole.slice(start, 50)
                values = [vars(fetcher(u)) for u in batch.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(values, _ARROW)], [*names, "fetched"])

    dealt = urls.repartition("domain").sortWithinPartitions("start_s") if {"domain", "start_s"} <= set(names) else urls
    made = dealt.mapInArrow(run, T.StructType([urls.schema[n] for n in names] + [T.StructField("fetched", _RESULT)]))
    return made.select("*", "fetched.*").drop("fetched")


def replay(urls: DataFrame, stored: DataFrame) -> DataFrame:
    """Like fetch, from stored pages (url, mime_type, content); addresses that aren't stored are errors."""
    joined = urls.join(stored.select("url", "mime_type", "content"), "url", "left")
    found = F.col("content").isNotNull()
    return joined.withColumn("status", F.when(found, F.lit(SUCCESS)).otherwise(F.lit(ERROR))).withColumn("error", F.when(~found, F.lit("not stored")))


def robots_bodies(domains: DataFrame, factory: Callable[[], Fetcher] = HttpFetcher) -> DataFrame:
    """(domain, body) from (domain, robots_url): null where the file can't be had, which allows everything."""
    got = fetch(domains.select("domain", F.col("robots_url").alias("url")), factory)
    return got.select("domain", F.when(F.col("status") == SUCCESS, F.make_valid_utf8(F.col("content").cast("string"))).alias("body"))


def step(known: DataFrame, rules: DataFrame, get: Callable[[DataFrame], DataFrame] = fetch, blocked: DataFrame | None = None, now_s: int = 0) -> tuple[DataFrame, DataFrame]:
    """One round: the pages fetched (url, mime_type, content), and the frontier with their links and states.

    Forbidden and fetched addresses are done; failed and rate-limited ones stay pending. get fetches a round's addresses;
    blocked and now_s hold rate-limited domains back, see frontier.round_of.
    """
    plan, after = frontier.round_of(known, rules, blocked, now_s)
    # Written, so that no address is fetched again when the pages are read for links and for the frontier.
    got = cut(get(plan).where(F.col("status") == SUCCESS).select("url", "mime_type", "content"), "fetched")
    links = pages.links(got).select(F.col("dst_url").alias("url"))
    return got, frontier.add(links, frontier.mark_done(after, got))
