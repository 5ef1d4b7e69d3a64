"""Vector tables: embedding, storing, and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodespan.schemas import DIMENSIONS
from lodespan.session import make_importable

#: Query vectors that one task keeps beside each batch of rows.
MOST_QUERIES = 10_000


class Embedder(Protocol):
    """Makes an array (texts, dimensions) of float32; loaded once for each Python worker by its factory."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


def hashed(dimensions: int = DIMENSIONS) -> Embedder:
    """Signed feature hashing of lower-case words, of unit length: no model is needed and results are reproducible."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float64)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = xxhash.xxh64_intdigest(word.encode())
                row[h % dimensions] += 1 if h >> 63 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(length == 0, 1, length)).astype(np.float32)

    return embed


def embed(df: DataFrame, factory: Callable[[], Embedder] = hashed, text: str = "text", made: str = "vector") -> DataFrame:
    """df with the column vector of each text; null texts have a null vector. An embedder's failure fails the job."""
    make_importable(df.sparkSession)
    names = [c for c in df.columns if c != made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = batch.column(text).to_pylist()
                vectors = model([t or "" for t in texts])
                values = pa.array([None if t is None else v for t, v in zip(texts, vectors, strict=True)], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), values], [*names, made])

    return df.mapInArrow(run, T.StructType([df.schema[n] for n in names] + [T.StructField(made, T.ArrayType(T.FloatType()))]))


def rows_of(messages: DataFrame, dimensions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (url, title, description, chunk_id, text, vector) of messages with parallel chunks and embeddings, and the
    messages that have none or not as many of both, with the reason."""
    matched = (F.size("chunks") > 0) & (F.size("chunks") == F.size("embeddings"))
    if dimensions is not None:
        matched = matched & F.forall("embeddings", lambda v: F.size(v) == dimensions)
    good = F.coalesce(matched, F.lit(False))
    zipped = messages.where(good).select("url", "title", "description", F.posexplode(F.arrays_zip("chunks", "embeddings")).alias("chunk_id", "pair"))
    rows = zipped.select("url", "title", "description", "chunk_id", F.col("pair.chunks").alias("text"), F.col("pair.embeddings").alias("vector"))
    return rows, messages.where(~good).withColumn("reason", F.lit("Chunks and embeddings length mismatch"))


def messages_of(rows: DataFrame) -> DataFrame:
    """Vector messages (url, title, description, chunks, embeddings) of embedded chunks, one for each address."""
    parts = F.sort_array(F.collect_list(F.struct("chunk_id", "text", "vector")))
    grouped = rows.groupBy("url").agg(F.first("title", ignorenulls=True).alias("title"), F.first("description", ignorenulls=True).alias("description"), parts.alias("parts"))
    return grouped.select("url", "title", "description", F.col("parts.text").alias("chunks"), F.col("parts.vector").alias("embeddings"))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision; null for vectors of unequal length."""
    off = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.aggregate(off, F.lit(0.0), lambda s, x: s + x))


def nearest(table: DataFrame, query: list[float], limit: int, key: list[str], vector: str = "vector") -> DataFrame:
    """key and vector_distance of the `limit` rows nearest to the query, ties by key: a top-k of each partition, then of these.

    Only key and vector are read; join the result back for other columns.
    """
    point = F.array(*(F.lit(float(x)) for x in query))
    far = table.select(*key, squared_distance(F.col(vector), point).alias("vector_distance")).where(F.col("vector_distance").isNotNull())
    return far.orderBy("vector_distance", *key).limit(limit)


def nearest_of_many(table: DataFrame, queries: DataFrame, limit: int, key: str, query_key: str, vector: str = "vector") -> DataFrame:
    """(query_key, key, vector_distance, place) of the nearest rows for every query (query_key, vector).

    Queries are dealt in blocks of MOST_QUERIES, each with a pass over the table: a task compares its rows with a block's
    queries and passes on the `limit` best for each, so the shuffle carries partitions * queries * limit rows.
    """
    make_importable(table.sparkSession)
    asked = queries.select(query_key, vector).toLocalIterator()
    parts = []
    while block := list(islice(asked, MOST_QUERIES)):
        parts.append(_nearest_of_block(table, [r[0] for r in block], np.array([r[1] for r in block], np.float64), limit, key, vector))
    if not parts:
        return table.select(F.col(key).alias(query_key), F.col(key), F.lit(0.0).alias("vector_distance"), F.lit(0).alias("place")).limit(0)
    place = F.row_number().over(Window.partitionBy("q").orderBy("vector_distance", "k"))
    ranked = reduce(DataFrame.unionAll, parts).withColumn("place", place).where(F.col("place") <= limit)
    return ranked.select(F.col("q").alias(query_key), F.col("k").alias(key), "vector_distance", "place")


def _nearest_of_block(table: DataFrame, ids: list[int], points: np.ndarray, limit: int, key: str, vector: str) -> DataFrame:
    """(q, k, vector_distance): the `limit` best rows of each partition for every point."""
    shared = table.sparkSession.sparkContext.broadcast((ids, points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sought = shared.value
        best: list[list[tuple[float, object]]] = [[] for _ in names]
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                rows = [(k, v) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if v is not None and len(v) == sought.shape[1]]
                if not rows:
                    continue
                block = np.array([v for _, v in rows], np.float64)
                for i, point in enumerate(sought):
                    off = block - point
                    far = np.einsum("ij,ij->i", off, off)
                    some = np.argpartition(far, limit - 1)[:limit] if len(far) > limit else np.arange(len(far))
                    edge = far[some].max()
                    best[i] = sorted(best[i] + [(float(far[j]), rows[j][0]) for j in np.flatnonzero(far <= edge)])[:limit]
        for name, found in zip(names, best, strict=True):
            if found:
                yield pa.RecordBatch.from_pydict({"q": pa.array([name] * len(found), pa.int64()), "k": pa.array([k for _, k in found], pa.int64()), "vector_distance": pa.array([d for d, _ in found], pa.float64())})

    return table.select(F.col(key).cast("long"), vector).mapInArrow(run, "q long, k long, vector_distance double")


def open_table(spark, name: str, schema: T.StructType) -> DataFrame:
    """The table called name, made empty with this schema if there is none."""
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], schema).write.saveAsTable(name)
    return spark.table(name)


def append(rows: DataFrame, name: str, dedupe: bool = False) -> None:
    """Appends rows to the table; dedupe leaves out chunks of addresses that it holds already."""
    spark = rows.sparkSession
    if dedupe and spark.catalog.tableExists(name):
        rows = rows.join(spark.table(name).select("url").distinct(), "url", "left_anti")
    rows.write.mode("append").saveAsTable(name)
