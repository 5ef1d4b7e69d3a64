"""Structured Streaming: ingest of document messages, of vector messages, and crawl states by domain."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodespan.operators import pages, vectors
from lodespan.schemas import BLOBS, DOCUMENT_MESSAGE, VECTOR_MESSAGE
from lodespan.session import make_importable
from lodespan.sources import tables


def ingest(spark: SparkSession, messages: str, blobs: str, out: str, dead: str, checkpoint: str) -> None:
    """Reads all JSON message files under `messages` that weren't read before, joins their blobs, and appends the chunks
    to `out` and bad messages and those without a blob, with the reason, to `dead`; ends when none is left.

    Offsets are checkpointed and each batch overwrites its own folder, so a batch that is run again changes nothing.
    """
    stream = spark.readStream.format("text").load(messages)

    def take(batch: DataFrame, number: int) -> None:
        good, bad = tables.from_messages(batch, DOCUMENT_MESSAGE)
        stored = spark.read.schema(BLOBS).parquet(blobs)
        parsed = pages.parse(tables.with_content(good, stored))
        pages.chunks(parsed).write.mode("overwrite").parquet(f"{out}/batch={number}")
        lost = tables.lost_blobs(good, stored).withColumn("reason", F.lit("blob not found"))
        dead_ones = bad.withColumn("reason", F.lit("not a document message")).unionByName(lost)
        dead_ones.write.mode("overwrite").parquet(f"{dead}/batch={number}")

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def index(spark: SparkSession, messages: str, out: str, dead: str, checkpoint: str, dimensions: int | None = None) -> None:
    """Reads all JSON vector message files under `messages` that weren't read before and appends their rows (url, title,
    description, chunk_id, text, vector) to `out`; texts that are no messages and those with unequal numbers of chunks and
    embeddings, or vectors of other than `dimensions`, go to `dead` with the reason. Ends when none is left; a batch that
    is run again changes nothing.
    """
    stream = spark.readStream.format("text").load(messages)

    def take(batch: DataFrame, number: int) -> None:
        good, bad = tables.from_messages(batch, VECTOR_MESSAGE)
        rows, unequal = vectors.rows_of(good, dimensions)
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
        odd = unequal.select(F.to_json(F.struct(*good.columns)).alias("value"), "reason")
        bad.withColumn("reason", F.lit("not a vector message")).unionByName(odd).write.mode("overwrite").parquet(f"{dead}/batch={number}")

    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def crawl_states(outcomes: DataFrame, delay_s: int = 2, longest: int = 300) -> DataFrame:
    """(domain, fetches, errors, blocked_until) after each batch of outcomes (domain, at, limited), from keyed state.

    errors counts rate limits in a row; a success resets it and the block. The clock is the data's: blocked_until is the
    time of the last rate limit plus min(longest, delay * 2 ** errors before it).
    """
    make_importable(outcomes.sparkSession)

    def update(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fetches, errors, blocked = state.get if state.exists else (0, 0, 0)
        for row in pd.concat(frames).sort_values(["at", "seq"]).itertuples():
            fetches += 1
            if row.limited:
                blocked = int(row.at) + min(longest, max(1, delay_s) * 2 ** min(errors, 9))
                errors += 1
            else:
                errors = blocked = 0
        state.update((fetches, errors, blocked))
        yield pd.DataFrame({"domain": [key[0]], "fetches": [fetches], "errors": [errors], "blocked_until": [blocked]})

    return outcomes.groupBy("domain").applyInPandasWithState(update, "domain long, fetches long, errors long, blocked_until long", "fetches long, errors long, blocked_until long", "update", GroupStateTimeout.NoTimeout)
