"""Search: query parsing, nearest chunks, reranking and snippets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodespan.functions import stem, text, urls
from lodespan.operators import vectors
from lodespan.schemas import DIMENSIONS
from lodespan.session import make_importable

LIMIT = 5


def overlap(query: Column, document: Column) -> Column:
    """The share of the query's distinct lower-case words that the document holds: the rerank score without a model."""
    words = lambda c: F.array_distinct(F.split(F.lower(text.clean(c)), " "))
    return F.size(F.array_intersect(words(query), words(document))) / F.size(words(query))


class Scorer(Protocol):
    """Scores texts for a query; loaded once for each Python worker by its factory."""

    def __call__(self, query: str, texts: list[str]) -> list[float]: ...


def rerank(df: DataFrame, query: str, factory: Callable[[], Scorer]) -> DataFrame:
    """df with the column score of each text, by a model that reads query and text together."""
    make_importable(df.sparkSession)
    names = [c for c in df.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for batch in batches:
            scores = model(query, [t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(list(scores), pa.float64())], [*names, "score"])

    return df.mapInArrow(run, T.StructType([df.schema[n] for n in names] + [T.StructField("score", T.DoubleType())]))


def results(ranked: DataFrame) -> DataFrame:
    """Search results of rows (url, title, description, text, vector_distance, score), best first.

    Ordered by score, then distance, address and chunk; nulls and NaN scores last.
    """
    score = F.when(F.isnan("score"), None).otherwise(F.col("score"))
    ordered = ranked.orderBy(score.desc_nulls_last(), "vector_distance", "url", "chunk_id")
    return ordered.select("url", "title", "description", "text", F.col("vector_distance").cast("float"), F.col("score").cast("float").alias("cross_encoder_score"), text.snippet(F.col("text")).alias("snippet"))


def search(table: DataFrame, query: str, limit: int = LIMIT, embedder=None, reranker=overlap, site: str | None = None, dimensions: int = DIMENSIONS) -> DataFrame:
    """The chunks nearest to the query, reranked: exactly `limit` candidates are reranked, none beyond.

    table has url, chunk_id, title, description, text, vector. A blank query is an error. reranker is a function of the
    query's and a text's column, or None for the order by distance. site keeps one host's chunks and is pushed down. The
    table is read twice, for distances and for the texts of the nearest: give a stored one. Without an embedder vectors
    are hashed to so many dimensions.
    """
    if not query or not query.strip():
        raise ValueError("the query is blank")
    embed = embedder or vectors.hashed(dimensions)
    point = [float(x) for x in embed([query])[0]]
    rows = table.where(urls.host(F.col("url")) == site.lower()) if site else table
    top = vectors.nearest(rows, point, limit, ["url", "chunk_id"])
    found = rows.drop("vector").join(F.broadcast(top), ["url", "chunk_id"])  # limit rows
    score = reranker(F.lit(query), F.col("text")) if reranker else F.lit(0.0)
    return results(found.withColumn("score", score))


def parse_query(df: DataFrame, query: str = "query", language: str = "language", stop_words: dict[str, list[str]] | None = None) -> DataFrame:
    """df with original_text, kept_words, site_filter and processed_text of each query.

    Words between white space; those that begin with `site:` are taken out, the last of them gives the filter. kept_words
    are the others in lower case without the language's stop words, processed_text their stems; unknown languages use
    English. stop_words has a list for each language.
    """
    known = stop_words or stem.stop_words()
    tokens = F.filter(F.split(text.clean(F.col(query)), " "), lambda t: t != "")
    is_site = lambda t: F.startswith(t, F.lit("site:"))
    sites = F.filter(tokens, is_site)
    plain = F.filter(tokens, lambda t: ~is_site(t))
    lists = F.lit(None).cast("array<string>")
    for code, words in known.items():
        lists = F.when(F.col(language) == code, F.array(*map(F.lit, words))).otherwise(lists)
    stops = F.coalesce(lists, F.array(*map(F.lit, known["en"])))
    first = df.withColumns({
        "original_text": F.array_join(plain, " "),
        "site_filter": F.regexp_extract(F.get(sites, F.size(sites) - 1), "^site:(.*)$", 1),
        "kept_words": F.filter(F.transform(plain, F.lower), lambda t: ~F.array_contains(stops, t)),
    })
    return stem.stemmed(first, "kept_words", language, "processed_text")
