"""Schemas of the search corpus's tables and messages."""

from __future__ import annotations

from pyspark.sql import types as T

#: Coordinates of an embedding unless said otherwise.
DIMENSIONS = 384


def _of(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_S, _L = T.StringType(), T.LongType()

FRONTIER = _of(("url", _S, False), ("status", _S, False))
BLOBS = _of(("id", _S, False), ("content", T.BinaryType(), True))
DOCUMENT_MESSAGE = _of(("url", _S, True), ("blob_id", _S, True), ("mime_type", _S, True))
VECTOR_MESSAGE = _of(("url", _S, True), ("title", _S, True), ("description", _S, True), ("chunks", T.ArrayType(_S), True), ("embeddings", T.ArrayType(T.ArrayType(T.FloatType())), True))
VECTORS = _of(("url", _S, False), ("title", _S, True), ("description", _S, True), ("text", _S, False), ("vector", T.ArrayType(T.FloatType(), False), False))
PARSED = _of(("text", _S, True), ("title", _S, True), ("description", _S, True))
SEARCH_RESULT = _of(("url", _S, False), ("title", _S, True), ("description", _S, True), ("text", _S, False), ("vector_distance", T.FloatType(), False), ("cross_encoder_score", T.FloatType(), False), ("snippet", _S, False))
