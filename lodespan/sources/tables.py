"""Sources and sinks: pages, blobs and queue messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodespan.schemas import BLOBS
from lodespan.session import table


def pages(spark: SparkSession, base: str) -> DataFrame:
    """(page_id, url, mime_type, content) of the table pages: fetched HTML."""
    return table(spark, base, "pages").select("page_id", "url", F.lit("text/html").alias("mime_type"), F.col("html").cast("binary").alias("content"))


def blob_id(content: Column) -> Column:
    """A blob's id is its content's digest, so storing it again changes nothing."""
    return F.sha2(content, 256)


def store_blobs(fetched: DataFrame, path: str, *keys: str) -> DataFrame:
    """Appends the distinct contents of fetched (url, mime_type, content) to the blobs at path; returns their messages,
    with the columns `keys` of fetched. A row without content stores no blob and its message names none."""
    rows = fetched.withColumn("id", blob_id(F.col("content")))
    known = rows.sparkSession.read.schema(BLOBS).parquet(path) if _exists(rows.sparkSession, path) else None
    fresh = rows.select("id", "content").where(F.col("id").isNotNull()).dropDuplicates(["id"])
    (fresh if known is None else fresh.join(known.select("id"), "id", "left_anti")).write.mode("append").parquet(path)
    return rows.select("url", F.col("id").alias("blob_id"), "mime_type", *keys)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def to_messages(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text in the column value."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def from_messages(values: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON texts in the column value, and those that aren't such rows: a text that fails or lacks a required
    address goes to the second."""
    parsed = values.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("row"))
    good = F.col("row").isNotNull() & F.col("row.url").isNotNull()
    return parsed.where(good).select("row.*"), parsed.where(~F.coalesce(good, F.lit(False))).select("value")


def with_content(messages: DataFrame, blobs: DataFrame) -> DataFrame:
    """(url, mime_type, content) of messages whose blob exists, and what other columns they have; lost_blobs has the others."""
    kept = [c for c in messages.columns if c != "blob_id"]
    return messages.join(blobs.select(F.col("id").alias("blob_id"), "content"), "blob_id").select(*kept, "content")


def lost_blobs(messages: DataFrame, blobs: DataFrame) -> DataFrame:
    """The messages whose blob doesn't exist, or that name none, as JSON texts in the column value."""
    lost = messages.join(blobs.select(F.col("id").alias("blob_id")), "blob_id", "left_anti").select(*messages.columns)
    return to_messages(lost)
