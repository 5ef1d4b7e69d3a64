"""The search service's calls as methods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespan.operators import search, vectors
from lodespan.operators.search import LIMIT


class Engine:
    """Searches a vector table (url, chunk_id, title, description, text, vector) with a model, or without."""

    def __init__(self, table: DataFrame, embedder: vectors.Embedder | None = None, reranker=search.overlap, dimensions: int = 384):
        self.table, self.reranker = table, reranker
        self.embedder = embedder or vectors.hashed(dimensions)

    def embed(self, text: str) -> list[float]:
        """A text's vector; a failing model raises."""
        return [float(x) for x in self.embedder([text])[0]]

    def knn(self, vector: list[float], limit: int = LIMIT) -> DataFrame:
        """The chunks nearest to a vector, as search results that aren't reranked."""
        top = vectors.nearest(self.table, vector, limit, ["url", "chunk_id"])
        found = self.table.drop("vector").join(F.broadcast(top), ["url", "chunk_id"])  # limit rows
        return search.results(found.withColumn("score", F.lit(0.0)))

    def search(self, query: str, limit: int = LIMIT, site: str | None = None) -> DataFrame:
        return search.search(self.table, query, limit, self.embedder, self.reranker, site)

    def search_json(self, query: str, limit: int = LIMIT) -> list[str]:
        """At most `limit` results as JSON texts, best first; nulls are kept as such."""
        rows = self.search(query, limit)
        return [r[0] for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]

    def rerank(self, query: str, documents: list[str], factory: Callable[[], search.Scorer] | None = None) -> list[float]:
        """Scores of documents in their order."""
        spark = self.table.sparkSession
        rows = spark.createDataFrame([(i, d) for i, d in enumerate(documents)], "i int, text string")
        scored = search.rerank(rows, query, factory) if factory else rows.withColumn("score", self.reranker(F.lit(query), F.col("text")))
        return [r["score"] for r in scored.orderBy("i").select("score").collect()]
