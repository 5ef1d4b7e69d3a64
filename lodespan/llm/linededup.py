"""Line deduplication across documents, with DataFrame functions only.

A line's key is the line without white space (`[\\x20\\x09-\\x0D]`) at both ends and with A-Z lower-cased. Keys of at least
`MIN_LENGTH` code points that at least `MIN_DOCUMENTS` documents hold lose their lines everywhere but in the document
with the largest id.

Lines travel as 128-bit hashes, never as text; they are hashed once and written. The hashes are range-partitioned and
sorted by hash, document (largest first) and position. One pass over a partition then streams the occurrences of each
hash: the first is the document that keeps it, and a document's first occurrence counts the document. What comes back per
document is its keep bitmap, compressed to runs. The whole text meets its bitmap only then.

A hash may hold a third of all lines. Hashes that stand out in a sample of `SAMPLE` lines are hot: at most SAMPLE / SHARE
of them, so their table may be broadcast. Their documents are counted exactly beforehand by partial aggregation, and their
lines are dealt to SALTS ranges each. The sample decides only how lines are dealt, never which are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespan.llm.frames import numbered, place
from lodespan.session import cut

MIN_LENGTH, MIN_DOCUMENTS, SALTS = 40, 5, 64
#: Lines of the sample that finds hot hashes, and how many of them make a hash hot.
SAMPLE, SHARE = 200_000, 100

_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(_BLANK)), _UPPER, _LOWER)


def lines(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _identity(key: str, text: str) -> list[Column]:
    """Rows of one document: its id and its text's hash, as repeated ids may have different texts."""
    return [F.col(key).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("print")]


def hashed_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(hash, doc, print, at) of each line whose key is long enough: a 128-bit hash of the key, and the line's place."""
    line = df.select(*_identity(key, text), F.posexplode(lines(F.col(text))).alias("at", "line"))
    found = line.select("doc", "print", "at", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_length)
    return found.select(F.unhex(F.md5("key")).alias("hash"), "doc", "print", "at")


def hot_hashes(hashed: DataFrame) -> DataFrame:
    """(hash, documents, largest) of hashes that very many lines have: at most SAMPLE / SHARE rows, about."""
    every = F.lit(max(1, hashed.count() // SAMPLE))
    drawn = hashed.where(F.pmod(F.xxhash64("doc", "print", "at"), every) == 0)
    standing = cut(drawn.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SHARE).select("hash"), "standing")
    holders = hashed.join(F.broadcast(standing), "hash", "left_semi").where("doc is not null").groupBy("hash", "doc").agg(F.lit(1).alias("one"))
    return cut(holders.groupBy("hash").agg(F.count("doc").alias("documents"), F.max("doc").alias("largest")), "hot")


def streamed(hashed: DataFrame, hot: DataFrame) -> DataFrame:
    """(doc, print, at, documents, largest) of each line: how many documents hold its hash, and the largest of them.

    The range partitioning and the order serve both windows: nothing is shuffled or sorted again.
    """
    dealt = hashed.join(F.broadcast(hot), "hash", "left")  # bounded by the sample
    salt = F.when(F.col("documents").isNotNull(), F.pmod(F.xxhash64("doc"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    dealt = dealt.select("hash", salt.cast("int").alias("salt"), "doc", "print", "at", F.col("documents").alias("known"), F.col("largest").alias("known_largest"))
    order = [F.col("hash"), F.col("salt"), F.col("doc").desc_nulls_last(), F.col("at")]
    ranged = dealt.repartitionByRange("hash", "salt").sortWithinPartitions(*order)
    stream = Window.partitionBy("hash", "salt").orderBy(*order[2:])
    first = F.col("doc").isNotNull() & ~F.coalesce(F.lag("doc").over(stream) == F.col("doc"), F.lit(False))
    flagged = ranged.withColumn("first", first).withColumn("top", F.first("doc").over(stream))
    whole = stream.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = flagged.withColumn("held", F.count_if("first").over(whole))
    return counted.select("doc", "print", "at", F.coalesce("known", "held").alias("documents"), F.coalesce("known_largest", "top").alias("largest"))


def _runs(places: Column) -> Column:
    """Sorted places as runs (start, length)."""
    begins = F.filter(places, lambda at, i: (i == 0) | (F.get(places, i - 1) != at - 1))
    ends = F.filter(places, lambda at, i: (i == F.size(places) - 1) | (F.get(places, i + 1) != at + 1))
    return F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length")))


def keep_bitmaps(df: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc, print, gone): for each document id and text that loses lines, the zeros of its keep bitmap as runs (start,
    length) of lines."""
    hashed = cut(hashed_lines(df, key, text, min_length), "lines")
    gone = streamed(hashed, hot_hashes(hashed)).where((F.col("documents") >= min_documents) & ((F.col("doc") != F.col("largest")) | F.col("doc").isNull()))
    places = gone.groupBy("doc", "print").agg(F.sort_array(F.collect_set("at")).alias("places"))
    return places.select("doc", "print", _runs(F.col("places")).alias("gone"))


def _lengths(gone: Column, size: Column) -> Column:
    """The keep bitmap as lengths of runs: kept, dropped, kept, ... lines, the first and last of which may be 0."""
    end = lambda run: run["start"] + run["length"]
    pairs = F.transform(gone, lambda run, i: F.array(run["start"] - F.when(i == 0, F.lit(0)).otherwise(end(F.get(gone, i - 1))), run["length"]))
    return F.concat(F.flatten(pairs), F.array(size - end(F.element_at(gone, -1))))


def _kept(parts: Column, gone: Column) -> Column:
    """The lines that stay."""
    before = F.concat(F.array(F.lit(0)), F.transform(gone, lambda run: run["start"] + run["length"]))
    after = F.concat(F.transform(gone, lambda run: run["start"]), F.array(F.size(parts)))
    return F.flatten(F.zip_with(before, after, lambda begin, end: F.slice(parts, begin + 1, end - begin)))


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """All rows and columns of df, text with the dropped lines taken out, and n_lines (before), n_dropped and keep_runs.

    keep_runs is the keep bitmap as run lengths: kept, dropped, kept, ... A null text stays null and counts as one empty
    line; very long texts are taken whole. Rows that share an id are one document when documents are counted; rows
    without an id count for none and lose the lines that others hold often enough. A text all of whose lines go becomes
    empty. Repeated rows stay, an empty table gives an empty table; other columns, whatever their names, pass through, but
    for the three of these names, which are replaced.
    """
    inner, id_, content = numbered(df), place(df, key), place(df, text)
    made = ("n_lines", "n_dropped", "keep_runs")
    names = [c for c in df.columns if c not in made]
    kept = [place(df, c) for c in names]
    bitmaps = keep_bitmaps(inner, id_, content, min_length, min_documents)
    rows = inner.select(*kept, F.xxhash64(F.coalesce(F.col(content), F.lit(""))).alias("row"))
    joined = rows.join(bitmaps, F.col(id_).eqNullSafe(F.col("doc")) & (F.col("row") == F.col("print")), "left")
    gone, parts = F.col("gone"), F.col("parts")
    split = joined.withColumn("parts", F.when(gone.isNotNull(), lines(F.col(content))))
    breaks = F.length(content) - F.length(F.replace(F.col(content), F.lit("\n"), F.lit("")))
    size = F.when(gone.isNull(), F.coalesce(breaks + 1, F.lit(1))).otherwise(F.size(parts))
    stays = F.when(gone.isNull(), F.col(content)).otherwise(F.array_join(_kept(parts, gone), "\n"))
    return split.select(
        *(stays.alias(c) if c == content else F.col(c) for c in kept),
        size.cast("long").alias("n_lines"),
        F.when(gone.isNull(), F.lit(0)).otherwise(F.aggregate(gone, F.lit(0), lambda n, run: n + run["length"])).cast("long").alias("n_dropped"),
        F.when(gone.isNull(), F.array(size)).otherwise(_lengths(gone, F.size(parts))).alias("keep_runs"),
    ).toDF(*names, *made)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each row of documents."""
    out = deduplicate(df.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: DuckDB SQL of `digests`.
SQL = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), often AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.last AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
