"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source is a queue of its documents in shuffled order, repeated in passes. Long documents are sent as packets of at
most PACKET words. A packet's virtual finish time is the words its source has sent up to the packet's end, divided by the
source's target. All packets are range-sorted by it and cut where the running sum of words reaches the total budget: what
lies before the cut is taken, the packet at the cut in part. In this order the sources interleave in proportion to their
targets, so at the cut each is within a packet or so of its own.

The running sum over the global order is that of the range partitions before a row's own, and that within it. A source may
hold a third of all rows, so its own running sum isn't taken in one window either: documents fall into buckets of the
shuffle order, about as many buckets as a bucket has rows. Equal rows are counted beforehand.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespan.llm.frames import numbered, place
from lodespan.session import cut

#: Weights that sources take in turn, the mix's size as a part of all words, how often a document may be used.
WEIGHTS, SHARE, PASSES, SEED = (3, 1, 2), 1.5, 2, 7
#: Words of a packet at most.
PACKET = 256


def words(text: Column) -> Column:
    """The number of `[^\\x20\\x09-\\x0D]+` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def lane(source: Column) -> Column:
    """A source as a text that is never null and sorts in code point order, null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def targets(sizes: DataFrame, share: float = SHARE, passes: int = PASSES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(lane, source_size, target) from (lane, source_size), one row for each source.

    Sources in order have the weights in turn and share `share` of all words by weight; a target stops at `passes` times
    its source's size and the excess goes to the others by weight, until none is above. The sources that stop are the
    first few by ceiling / weight: as many as come before the first whose ratio reaches what the rest of the budget
    gives per rest of the weight. Running sums find it without iteration. The windows lie in one task, which sees one
    row of about 60 bytes for each source: good for millions of sources, not for billions.
    """
    by_name, by_ratio, whole = Window.orderBy("lane"), Window.orderBy("ratio", "lane"), Window.partitionBy()
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn + 1)
    weighed = sizes.select("lane", "source_size", weight.alias("weight"), (F.col("source_size") * passes).cast("double").alias("ceiling"))
    ranked = weighed.withColumn("ratio", F.col("ceiling") / F.col("weight"))
    spent, lighter = (F.coalesce(F.sum(c).over(earlier), F.lit(0.0)) for c in ("ceiling", "weight"))
    budget, total = F.sum("source_size").over(whole) * share, F.sum("weight").over(whole)
    levels = ranked.withColumn("per_weight", (budget - spent) / (total - lighter))
    level = F.min_by("per_weight", F.when(F.col("per_weight") <= F.col("ratio"), F.struct("ratio", "lane"))).over(whole)
    return levels.withColumn("level", level).select("lane", "source_size", F.coalesce(F.least("ceiling", F.col("level") * F.col("weight")), "ceiling").alias("target"))


def _sized(df: DataFrame, key: str, source: str, text: str) -> list[Column]:
    return [F.col(key).alias("key"), lane(F.col(source)).alias("lane"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("print")]


def running(df: DataFrame, order: list[str], amount: str) -> DataFrame:
    """df range-sorted by order, with the column before: the sum of amount over all rows ahead in the whole order.

    The sums of range partitions are one row for each partition, of which one task takes the running sum.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "placed")
    parts = placed.groupBy("part").agg(F.sum(amount).alias("whole"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut(parts.select("part", F.coalesce(F.sum("whole").over(earlier), F.lit(0)).alias("ahead")), "parts")
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.repartitionByRange("part").withColumn("inside", F.sum(amount).over(inside) - F.col(amount))
    return summed.join(parts, "part").withColumn("before", F.col("ahead") + F.col("inside")).drop("part", "ahead", "inside")


def schedule(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", share: float = SHARE, passes: int = PASSES, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED, packet: int = PACKET) -> DataFrame:
    """All packets of all uses of all rows in the order of the mix: (key, lane, print, number, size, pass, packet, length,
    virtual_finish, before, taken, source_size, target). A packet beyond the budget has taken 0.

    A row of df is (key, lane, print, number): its id, its source, its text's hash, and a number that tells rows equal in
    these apart. Null keys and sources are values like any other. Documents without words have one packet that takes
    nothing; very long ones have many. An empty table gives an empty schedule. The order depends on ids, texts and seed
    only, so reruns agree.
    """
    uses, shares = _schedule(_rows(df, key, source, text), share, passes, weights, seed, packet)
    return uses.join(shares, "lane")


def _rows(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    sized = df.select(*_sized(df, key, source, text), words(F.col(text)).alias("size"))
    return cut(sized.groupBy("key", "lane", "print", "size").agg(F.count(F.lit(1)).alias("copies")), "sizes")


def _schedule(rows: DataFrame, share: float, passes: int, weights: tuple[int, ...], seed: int, packet: int) -> tuple[DataFrame, DataFrame]:
    """The schedule of (key, lane, print, size, copies), and (lane, source_size, target)."""
    buckets = F.lit(max(1, isqrt(rows.count()))).cast("long")
    placed = rows.withColumn("order", F.xxhash64(F.lit(seed), "key", "print")).withColumn("bucket", F.pmod("order", buckets)).withColumn("whole", F.col("size") * F.col("copies"))
    sums = cut(placed.groupBy("lane", "bucket").agg(F.sum("whole").alias("in_bucket")), "buckets")
    shares = cut(targets(sums.groupBy("lane").agg(F.sum("in_bucket").alias("source_size")), share, passes, weights), "targets")
    budget = shares.agg(F.round(F.sum("target")).cast("long")).first()[0] or 0
    ahead = sums.select("lane", "bucket", (F.sum("in_bucket").over(Window.partitionBy("lane").orderBy("bucket")) - F.col("in_bucket")).alias("ahead"))
    known = cut(ahead.join(shares, "lane"), "ahead")
    together = Window.partitionBy("lane", "bucket").orderBy("order", "key", "print", "size").rowsBetween(Window.unboundedPreceding, 0)
    lined = placed.withColumn("inside", F.sum("whole").over(together) - F.col("whole")).join(known, ["lane", "bucket"])
    own = lined.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("number"))
    uses = own.select("*", F.explode(F.array(*(F.lit(p) for p in range(passes)))).alias("pass"))
    last = F.greatest(F.ceil(F.col("size") / packet) - 1, F.lit(0).cast("long"))
    sent = uses.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("packet"))
    length = F.least(F.col("size") - F.col("packet") * packet, F.lit(packet).cast("long"))
    start = F.col("pass") * F.col("source_size") + F.col("ahead") + F.col("inside") + (F.col("number") - 1) * F.col("size") + F.col("packet") * packet
    timed = sent.select("key", "lane", "print", "number", "size", "pass", "packet", length.alias("length"), F.try_divide((start + length).cast("double"), F.col("target")).alias("virtual_finish"))
    queued = running(timed, ["virtual_finish", "lane", "pass", "key", "print", "size", "number", "packet"], "length")
    taken = F.greatest(F.least("length", F.lit(budget) - F.col("before")), F.lit(0).cast("long"))
    return queued.withColumn("taken", taken), shares


def _taken(uses: DataFrame, *more: str) -> DataFrame:
    return uses.groupBy("key", "lane", "print", "number", "size", *more).agg(F.sum("taken").alias("taken"))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of df, as often as the mix uses them, with all their columns, whatever their names.

    Whole documents are used: one that the cut divides stays if at least half of its words are taken. Rows repeated in df
    are told apart, and each has its own uses. Nulls, empty and very long texts: see schedule.
    """
    inner, id_, origin, content = numbered(df), place(df, key), place(df, source), place(df, text)
    used = _taken(schedule(inner, id_, origin, content, **options), "pass").where((F.col("taken") > 0) & (2 * F.col("taken") >= F.col("size")))
    counted = cut(used.groupBy("key", "lane", "print", "number").agg(F.count(F.lit(1)).cast("int").alias("uses")), "uses")
    right = counted.select(F.col("key").alias("key2"), F.col("lane").alias("lane2"), F.col("print").alias("print2"), F.col("number").alias("number2"), "uses")
    own = inner.select("*", *_sized(inner, id_, origin, content))
    own = own.withColumn("number", F.row_number().over(Window.partitionBy("key", "lane", "print").orderBy(F.lit(0))))
    same = F.col("key").eqNullSafe(F.col("key2")) & (F.col("lane") == F.col("lane2")) & (F.col("print") == F.col("print2")) & (F.col("number") == F.col("number2"))
    return own.join(right, same).withColumn("use", F.explode(F.sequence(F.lit(1), F.col("uses")))).select(*inner.columns).toDF(*df.columns)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row of documents, those that the mix leaves out too."""
    uses, shares = _schedule(_rows(df, "doc_id", "source", "text"), SHARE, PASSES, WEIGHTS, SEED, PACKET)
    return _taken(uses).join(shares, "lane").select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")
