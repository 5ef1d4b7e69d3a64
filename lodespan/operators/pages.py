"""Pages to parsed documents, links and chunks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodespan.functions import extract, text, urls
from lodespan.session import make_importable


def kind(mime_type: Column) -> Column:
    return F.when(F.contains(mime_type, F.lit("application/pdf")), F.lit("pdf")).when(F.contains(mime_type, F.lit("xml")), F.lit("xml")).otherwise(F.lit("html"))


def _map(df: DataFrame, made: str, arrow: pa.DataType, spark_type: T.DataType, function) -> DataFrame:
    """df without content, with the column `made` of function(content, mime_type, url)."""
    make_importable(df.sparkSession)
    names = [c for c in df.columns if c not in ("content", made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                values = [None if c is None or u is None else function(c, m or "", u) for c, m, u in zip(*(batch.column(n).to_pylist() for n in ("content", "mime_type", "url")), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(values, arrow)], [*names, made])

    return df.mapInArrow(run, T.StructType([df.schema[n] for n in names] + [T.StructField(made, spark_type)]))


def _parsed(content: bytes, mime_type: str, url: str, written: bool) -> dict:
    try:
        found = extract.parse(content, mime_type, url, written)
    except extract.BadPdf as error:
        return {"text": None, "title": None, "description": None, "error": str(error)}
    return {"text": found.text, "title": found.title, "description": found.description, "error": None}


_STRUCT = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "title", "description", "error")])


def parse(pages: DataFrame, written: bool = False) -> DataFrame:
    """Pages (url, mime_type, content binary, ...) with text, title, description and error in place of content.

    A PDF that can't be read has no text but an error. Null content gives nulls. If written, titles and references of HTML
    stay as they are written (extract.parse_html).
    """
    made = _map(pages, "parsed", pa.struct([(n, pa.string()) for n in _STRUCT.names]), _STRUCT, partial(_parsed, written=written))
    return made.select("*", "parsed.*").drop("parsed")


def links(pages: DataFrame) -> DataFrame:
    """(src_url, dst_url, dst_domain): the distinct links of each page; links without a host are left out."""
    found = _map(pages.select("url", "mime_type", "content"), "links", pa.list_(pa.string()), T.ArrayType(T.StringType()), extract.links)
    one = found.select(F.col("url").alias("src_url"), F.explode("links").alias("dst_url"))
    return one.withColumn("dst_domain", urls.host(F.col("dst_url"))).where(F.col("dst_domain").isNotNull())


def by_shard(found: DataFrame, shards: int) -> DataFrame:
    """(shard, n_links): how many links each shard of domains has to take; the links themselves stay rows."""
    return found.groupBy(urls.shard(F.col("dst_domain"), shards).alias("shard")).agg(F.count(F.lit(1)).alias("n_links"))


def chunks(parsed: DataFrame, most: int = text.CHUNK_WORDS, overlap: int = text.CHUNK_OVERLAP) -> DataFrame:
    """(url, title, description, chunk_id, text) of parsed documents; documents without chunks are left out."""
    cleaned = parsed.where(F.col("text").isNotNull()).select("url", "title", "description", "text")
    made = text.chunks(cleaned, most=most, overlap=overlap)
    return made.select("url", "title", "description", F.posexplode("chunks").alias("chunk_id", "text"))
