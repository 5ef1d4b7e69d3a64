"""SimHash near-duplicates by segment popcounts.

A fingerprint's 64 bits form 32 segments of two bits; the vector of their popcounts (0 to 2) embeds it so that the
Manhattan distance of two vectors never exceeds the Hamming distance of the fingerprints. Fingerprints that differ in
at most `RADIUS` = 3 bits are therefore at most 1 apart in the first or in the last 16 coordinates. Each half is a grid
whose cells are its integer vectors: a fingerprint lies in its own cell and is copied to the 16 cells one step up, so
two fingerprints at most one step apart meet in a cell. Fingerprints that meet are verified by their exact distance.

Equal fingerprints are joined beforehand. A cell's fingerprints are linked as a spanning forest, not as pairs, and a
cell with more than `BLOCK` of them is dealt out as pairs of blocks to many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespan.llm.components import stars
from lodespan.session import cut, make_importable

SHINGLE, SEED, RADIUS, BLOCK = 3, 42, 3, 1024
#: Cells with at most so many fingerprints are compared all at once.
FEW = 16


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; 0 for a text without words (or null)."""
    words = (text or "").encode().lower().split()  # of bytes, both treat ASCII only: A-Z, and \\x20 \\x09-\\x0D
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) <= size:
        spans = [line]
    else:
        spans = [line[a : b - 1] for a, b in zip([0, *ends], ends[size - 1 :], strict=False)]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for start in range(0, len(spans), 1 << 15):
        hashes = np.array([digest(s, seed) for s in spans[start : start + (1 << 15)]], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(spans), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", made: str = "fp", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Replaces the column text by fp, the fingerprint of the whole text as a signed long. Other columns pass through."""
    make_importable(df.sparkSession)
    names = [c for c in df.columns if c not in (text, made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, size, seed) for t in batch.column(text).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(prints)], [*names, made])

    return df.mapInArrow(run, df.select(*names, F.lit(0).cast("long").alias(made)).schema)


def _print(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _popcounts(half: Column) -> Column:
    """Of 32 bits: 16 two-bit fields, each with the number of bits set in it."""
    return half - F.shiftright(half, 1).bitwiseAND(0x55555555)


def cells(prints: DataFrame) -> DataFrame:
    """(cell, fp) for both halves of every fp: its own cell and each one step up."""
    low, high = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)
    own = prints.select("fp", F.explode(F.array(_popcounts(low), _popcounts(high) + F.lit(1 << 33))).alias("own"))
    steps = F.array(*(F.lit(1 << 2 * i).cast("long") for i in range(16)))
    up = F.filter(steps, lambda s: F.col("own").bitwiseAND(s + s) == 0)  # a field that holds 2 has no step up
    near = F.concat(F.array("own"), F.transform(up, lambda s: F.col("own") + s))
    return own.select(F.explode(near).alias("cell"), "fp")


def _forest(prints: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints."""
    rest = prints
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            linked = np.bitwise_count(rest ^ one) <= RADIUS
            for other in rest[linked]:
                queue.append(other)
                yield one, other
            rest = rest[~linked]


def links_of_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the cells of rows sorted by (cell, i, j); at most one cell is held besides a batch."""
    held = np.empty((0, 4), np.int64)

    def found(rows: np.ndarray) -> pa.RecordBatch:
        key, prints = rows[:, :3], rows[:, 3].view(np.uint64)
        begins = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        sizes = np.diff(np.append(begins, len(rows)))
        number = np.repeat(np.arange(len(sizes)), sizes)
        small = np.repeat(sizes <= FEW, sizes)
        lefts, rights = [], []
        for step in range(1, min(FEW, int(sizes.max()))):
            at = np.flatnonzero((number[step:] == number[:-step]) & small[step:])
            at = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= RADIUS]
            lefts.append(prints[at])
            rights.append(prints[at + step])
        for group in np.flatnonzero(sizes > FEW):
            pairs = list(_forest(np.unique(prints[begins[group] : begins[group] + sizes[group]])))
            if pairs:
                ends = np.array(pairs, np.uint64)
                lefts.append(ends[:, 0])
                rights.append(ends[:, 1])
        a, b = (np.concatenate(x or [np.empty(0, np.uint64)]).view(np.int64) for x in (lefts, rights))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate([held, np.stack([batch.column(n).to_numpy() for n in ("cell", "i", "j", "fp")], axis=1)])
        last = int(np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1)).max(initial=-1)) + 1
        held = rows[last:]
        if last:
            yield found(rows[:last])
    if len(held):
        yield found(held)


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect what links of at most RADIUS bits connect, among the distinct longs fp of prints.

    Two fingerprints that differ in so few bits are always connected, if not by an edge of their own.
    """
    make_importable(prints.sparkSession)
    near = cells(prints)
    # Cut, so that its size is known before the join is planned: small, it is broadcast; else the join is dealt by cell.
    crowded = cut(near.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("cell", F.ceil(F.col("n") / block).cast("long").alias("blocks")), "crowded")
    own = F.when(F.col("blocks").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("fp"), F.col("blocks")))
    dealt = near.join(crowded, "cell", "left").withColumn("k", own)
    pairs = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = dealt.select("cell", "fp", "k", F.explode(pairs).alias("other"))
    dealt = dealt.select("cell", F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"), "fp")
    met = dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "fp")
    return met.mapInArrow(links_of_cells, "a long, b long").distinct()


def components(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component, print): the smallest key of the documents that links of at most RADIUS bits reach from a row,
    and a hash of the row's text.

    Rows with one text share a fingerprint, so repeated rows and ties are joined; null and wordless texts have
    fingerprint 0 and are linked like any other. A row with a null key keeps its place and adds no key. Other columns are
    left out; an empty table gives an empty table.
    """
    prints = cut(fingerprints(df.select(F.col(key).alias("key"), _print(text).alias("print"), F.col(text).alias("text"))), "prints")
    distinct = cut(prints.groupBy("fp").agg(F.min("key").alias("first")), "distinct")
    roots = stars(links(distinct.select("fp")))
    roots = roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
    firsts = cut(roots.join(distinct, roots.node == distinct.fp).select("fp", "root", "first"), "firsts")
    least = cut(firsts.groupBy("root").agg(F.min("first").alias("component")), "least")
    linked = cut(firsts.join(least, "root").select("fp", "component"), "linked")
    named = cut(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component", "first").alias("component")), "named")
    return prints.join(named, "fp").select(F.col("key").alias(key), "fp", "component", "print")


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df whose key is the smallest of their component, with all columns as they are.

    One document of each group of near-duplicates stays; rows with the same key and text stay together. A row with a null
    key is kept if nothing with a key is in its component.
    """
    found = components(df, key, text).where(F.col(key).eqNullSafe(F.col("component")))
    kept = cut(found.select(F.col(key).alias("_kept"), F.col("print").alias("_print")).distinct(), "kept")
    return df.join(kept, F.col(key).eqNullSafe(F.col("_kept")) & (_print(text) == F.col("_print")), "left_semi")


def digests(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of each row of documents."""
    return components(df).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
