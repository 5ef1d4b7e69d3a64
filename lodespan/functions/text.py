"""Text functions: cleaning, snippets, word counts, sentences and overlapping chunks."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodespan.session import make_importable

CHUNK_WORDS, CHUNK_OVERLAP, SNIPPET = 200, 2, 160
#: Unicode white space, in the JVM's and in Python's regular expressions.
_SPACE = "(?U)\\s+"
_PY_SPACE = regex.compile(r"\p{White_Space}+")


def clean(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def snippet(text: Column, size: int = SNIPPET) -> Column:
    """The first `size` characters and an ellipsis of a longer text."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def word_count(text: Column) -> Column:
    cleaned = clean(text)
    return F.when(cleaned == "", F.lit(0)).otherwise(F.size(F.split(cleaned, " ")))


def utf8(content: Column) -> Column:
    """Bytes as text, what isn't UTF-8 as U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


@lru_cache(maxsize=1)
def _patterns() -> dict[str, regex.Pattern]:
    ext = r"[\p{SB=EX}\p{SB=FO}]*"
    line = r"(?:\p{SB=CR}\p{SB=LF}|[\p{SB=SE}\p{SB=CR}\p{SB=LF}])"
    return {
        "end": regex.compile(rf"{line}|(?P<term>[\p{{SB=AT}}\p{{SB=ST}}]){ext}(?P<after>(?:\p{{SB=CL}}{ext})*(?:\p{{SB=SP}}{ext})*)(?P<line>{line}?)"),
        "a": regex.compile(r"\p{SB=AT}"),
        "digit": regex.compile(r"\p{SB=NU}"),
        "upper": regex.compile(r"\p{SB=UP}"),
        "letter_before": regex.compile(rf"(?r)[\p{{SB=UP}}\p{{SB=LO}}]{ext}"),
        "lower_next": regex.compile(r"[^\p{SB=LE}\p{SB=UP}\p{SB=LO}\p{SB=SE}\p{SB=CR}\p{SB=LF}\p{SB=AT}\p{SB=ST}]*\p{SB=LO}"),
        "goes_on": regex.compile(r"[\p{SB=SC}\p{SB=AT}\p{SB=ST}]"),
        "word": regex.compile(r"[\p{L}\p{N}]"),
    }


def sentences(text: str) -> list[str]:
    """Sentences by Unicode's standard annex 29, trimmed; those without a letter or digit are left out."""
    p, out, start = _patterns(), [], 0
    for m in p["end"].finditer(text):
        at = m.end()
        if m["term"] and not m["line"] and at < len(text):
            if p["goes_on"].match(text, at):
                continue
            if p["a"].match(m["term"]):
                if not m["after"] and (p["digit"].match(text, at) or (p["upper"].match(text, at) and p["letter_before"].match(text, 0, m.start()))):
                    continue
                if p["lower_next"].match(text, at):
                    continue
        out.append(text[start:at])
        start = at
    out.append(text[start:])
    return [s for s in map(str.strip, out) if p["word"].search(s)]


def chunk_spans(words: list[int], most: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> list[tuple[int, int]]:
    """Sentences [start, end) of each chunk: as many as stay within `most` words, one at least; the next chunk begins
    `overlap` sentences before the end, but after the start. The chunk that reaches the last sentence is the last."""
    sums, spans, start = list(accumulate(words, initial=0)), [], 0
    while start < len(words):
        end = max(start + 1, bisect_right(sums, sums[start] + most) - 1)
        spans.append((start, end))
        if end >= len(words):
            break
        start = max(start + 1, end - overlap)
    return spans


def chunk(text: str, most: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> list[str]:
    parts = sentences(text)
    counts = [len([w for w in _PY_SPACE.split(s) if w]) for s in parts]
    return [" ".join(parts[a:b]) for a, b in chunk_spans(counts, most, overlap)]


def chunks(df: DataFrame, text: str = "text", most: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """df with the column text replaced by chunks, an array of its overlapping chunks; null texts have none.

    One pass over each partition, no shuffle: a document's sentences are found and joined where its row is.
    """
    make_importable(df.sparkSession)
    names = [c for c in df.columns if c not in (text, "chunks")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [chunk(_PY_SPACE.sub(" ", t).strip(), most, overlap) if t else [] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(made, pa.list_(pa.string()))], [*names, "chunks"])

    return df.mapInArrow(run, T.StructType([df.schema[n] for n in names] + [T.StructField("chunks", T.ArrayType(T.StringType()))]))


def chunk_table(df: DataFrame, key: str, sentences_: Column, most: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(key, chunk_id, first, last, text) from an array of sentences, with DataFrame functions only.

    A range window over words before a sentence finds where a chunk that began there would end; folding these ends in
    order visits the real beginnings.
    """
    rows = df.select(F.col(key).alias("key"), F.array_compact(sentences_).alias("parts")).where(F.size("parts") > 0)
    one = rows.select("key", F.size("parts").alias("n"), F.posexplode(F.concat("parts", F.array(F.lit("")))).alias("i", "sentence"))
    counted = one.withColumn("before", F.coalesce(F.sum(F.when(F.col("i") < F.col("n"), word_count(F.col("sentence")))).over(Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    reach = F.max("i").over(Window.partitionBy("key").orderBy("before").rangeBetween(Window.currentRow, most))
    ends = counted.withColumn("end", F.greatest(F.col("i") + 1, reach)).where("i < n")
    per_key = ends.groupBy("key").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "end"))).alias("steps"), F.transform(F.sort_array(F.collect_list(F.struct("i", "sentence"))), lambda x: x["sentence"]).alias("parts"))
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<i:int,end:int>>").alias("taken"))
    # A chunk that reaches the last sentence is the last: no sentence has the number n that follows it.
    step = lambda acc, s: F.when(s["i"] == acc["next"], F.struct(F.when(s["end"] == F.col("n"), F.col("n")).otherwise(F.greatest(s["i"] + 1, s["end"] - overlap)).alias("next"), F.concat(acc["taken"], F.array(F.struct(s["i"].alias("i"), s["end"].alias("end")))).alias("taken"))).otherwise(acc)
    folded = per_key.select("key", "parts", F.aggregate("steps", start, step)["taken"].alias("taken"))
    made = folded.select("key", "parts", F.posexplode("taken").alias("chunk_id", "span"))
    return made.select(
        F.col("key").alias(key), "chunk_id", F.col("span.i").alias("first"), (F.col("span.end") - 1).alias("last"),
        F.array_join(F.slice("parts", F.col("span.i") + 1, F.col("span.end") - F.col("span.i")), " ").alias("text"),
    )
