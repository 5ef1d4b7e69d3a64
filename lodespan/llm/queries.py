"""The registered queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodespan.llm import bpe, licenses, linededup, media, mixing, quality, simhash, tokencount, toxicity, warc
from lodespan.session import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_licenses(spark: SparkSession, base: str) -> DataFrame:
    return licenses.digests(table(spark, base, "documents"))


def op2_bpe(spark: SparkSession, base: str) -> DataFrame:
    return bpe.digests(table(spark, base, "documents"), RANKS, public_tokenizers.PATTERN)


def op3_gif(spark: SparkSession, base: str) -> DataFrame:
    return media.digests(table(spark, base, "documents"))


def op4_tokens(spark: SparkSession, base: str) -> DataFrame:
    return tokencount.token_counts(table(spark, base, "documents").select("doc_id", "text"), RANKS, public_tokenizers.PATTERN)


def op6_toxicity(spark: SparkSession, base: str) -> DataFrame:
    return toxicity.digests(table(spark, base, "documents"), table(spark, base, "labels"))


def op5_linededup(spark: SparkSession, base: str) -> DataFrame:
    return linededup.digests(table(spark, base, "documents"))


def op7_mixing(spark: SparkSession, base: str) -> DataFrame:
    return mixing.digests(table(spark, base, "documents"))


def op8_simhash(spark: SparkSession, base: str) -> DataFrame:
    return simhash.digests(table(spark, base, "documents"))


def op9_warc(spark: SparkSession, base: str) -> DataFrame:
    return warc.digests(table(spark, base, "pages"))


def op10_quality(spark: SparkSession, base: str) -> DataFrame:
    return quality.digests(table(spark, base, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_bpe": op2_bpe,
    "op3_gif": op3_gif,
    "op4_tokens": op4_tokens,
    "op5_linededup": op5_linededup,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_simhash": op8_simhash,
    "op9_warc": op9_warc,
    "op10_quality": op10_quality,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op1_licenses": licenses.sql(),
    "op5_linededup": linededup.SQL,
    "op9_warc": warc.SQL,
}
