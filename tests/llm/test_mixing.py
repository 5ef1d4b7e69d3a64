from __future__ import annotations

import math

import pytest
import xxhash  # noqa: F401
from pyspark.sql import functions as F

from lodespan.llm import mixing


def water_fill(sizes, weights, share, passes):
    """Targets by filling again and again."""
    budget, stopped = share * sum(sizes), set()
    while True:
        rest = budget - sum(passes * sizes[i] for i in stopped)
        weight = sum(w for i, w in enumerate(weights) if i not in stopped)
        given = [passes * s if i in stopped else rest * w / weight for i, (s, w) in enumerate(zip(sizes, weights))]
        over = {i for i, (g, s) in enumerate(zip(given, sizes)) if g > passes * s}
        if not over - stopped:
            return given
        stopped |= over


@pytest.mark.parametrize("sizes", [[10, 10, 10], [100, 1, 1, 50, 7], [5], [0, 10, 10], [1, 2, 3, 4, 5, 6, 7, 8], [1000, 1, 1, 1]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"0{chr(97 + i)}", s) for i, s in enumerate(sizes)], "lane string, source_size long")
    got = [r["target"] for r in mixing.targets(rows).orderBy("lane").collect()]
    want = water_fill(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sizes))], 1.5, 2)
    assert got == pytest.approx(want)


def corpus(spark):
    rows = [(n, " ".join(["w"] * (n % 13)), ["b", "a", None, "é", "Z"][n % 5 if n % 7 else 0], "x") for n in range(300)]
    rows += [(5, "again and again", "b", "x"), (5, "again and again", "b", "x"), (None, "no id", "a", "x"), (400, None, "a", "x"), (401, " \n", "a", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def test_documents_against_brute_force(spark):
    df = corpus(spark)
    got = mixing.digests(df).collect()
    assert len(got) == df.count()
    size = lambda t: len((t or "").split())
    by = {}
    for r in df.collect():
        by[r["source"]] = by.get(r["source"], 0) + size(r["text"])
    names = sorted(by, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, water_fill([by[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))], 1.5, 2)))
    uses = mixing.schedule(df)
    totals = {r["lane"]: (r["t"], r["target"]) for r in uses.groupBy("lane").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()}
    for name in names:
        taken, target = totals["1" if name is None else "0" + name]
        assert target == pytest.approx(want[name]) and abs(taken - target) <= 13  # a document
    assert sum(t for t, _ in totals.values()) == math.floor(sum(want.values()) + 0.5)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    # In each source, what is taken is a beginning of its queue, in two passes.
    for lane in totals:
        own = uses.where(F.col("lane") == lane).where("size > 0").orderBy("before").collect()
        cut = [r["taken"] == r["size"] for r in own]
        assert cut == sorted(cut, reverse=True) and sum(0 < r["taken"] < r["size"] for r in own) <= 1


def test_reruns_and_partitions_agree(spark):
    df = corpus(spark)
    once, again = (sorted(map(tuple, mixing.digests(x).collect()), key=str) for x in (df, df.repartition(7, "text")))
    assert once == again


def test_order_interleaves_sources(spark):
    order = mixing.schedule(corpus(spark)).where("taken > 0").orderBy("before")
    finish = [r[0] for r in order.select("virtual_finish").collect()]
    assert finish == sorted(finish)
    early = order.where("virtual_finish <= 0.5").groupBy("lane").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"] / 2) <= 13 for r in early)


def test_mixed_rows(spark):
    df = corpus(spark)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and all(r["size"] == "x" for r in mixed.collect())
    uses = mixing.schedule(df).where((F.col("taken") > 0) & (2 * F.col("taken") >= F.col("size"))).count()
    assert mixed.count() == uses
    copies = mixed.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0]
    assert copies <= 4  # twice each, and one text is there twice
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.digests(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = mixing.digests(corpus(spark).limit(3))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


@pytest.mark.parametrize("sizes", [[300, 100, 200], [10, 20, 30, 10], [0, 0, 0, 5]])
def test_targets_of_tied_ratios(spark, sizes):
    rows = spark.createDataFrame([(f"0{chr(97 + i)}", s) for i, s in enumerate(sizes)], "lane string, source_size long")
    got = [r["target"] for r in mixing.targets(rows).orderBy("lane").collect()]
    want = water_fill(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sizes))], 1.5, 2)
    assert got == pytest.approx(want) and sum(got) == pytest.approx(1.5 * sum(sizes))


def test_queue_by_brute_force(spark):
    """Each document's words, from a queue that is built, sorted and cut in one list."""
    df = corpus(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    df = df.unionByName(spark.createDataFrame([(500, "w " * 5000, "b", "x"), (501, "w " * 3001, "Z", "x")], df.schema))
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in df.collect()}
    prints = {r["doc_id"]: (r["source"], r["print"], r["order"]) for r in df.select("doc_id", "source", *mixing._sized(df, "doc_id", "source", "text")[2:]).withColumn("order", F.xxhash64(F.lit(mixing.SEED), "doc_id", "print")).collect()}
    names = sorted({v[0] for v in prints.values()}, key=lambda s: (s is None, s or ""))
    whole = {s: sum(size[d] for d, v in prints.items() if v[0] == s) for s in names}
    target = dict(zip(names, water_fill([whole[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))], 1.5, 2), strict=True))
    buckets, queue = math.isqrt(len(size)), []
    for place, s in enumerate(names):
        sent = 0
        own = sorted((d for d, v in prints.items() if v[0] == s), key=lambda d: (prints[d][2] % buckets, prints[d][2], d))
        for turn in range(2):
            for d in own:
                for begin in range(0, max(1, size[d]), mixing.PACKET):
                    length = min(mixing.PACKET, size[d] - begin)
                    sent += length
                    queue.append((sent / target[s] if target[s] else -1.0, place, turn, d, prints[d][1], begin, length))
    left, taken = math.floor(sum(target.values()) + 0.5), dict.fromkeys(size, 0)
    for *_, d, _, _, length in sorted(queue):
        taken[d] += min(length, left)
        left -= min(length, left)
    assert {r["doc_id"]: r["taken"] for r in mixing.digests(df).collect()} == taken


def test_columns_of_any_name_and_equal_rows(spark):
    names = ["_use", "_number", "_key", "_lane", "_k", "_uses", "key", "lane", "print", "number", "use", "uses", "a.b", "c0"]
    rows = [(n % 4, "same words here", "s", *names) for n in range(40)] + [(n, f"own {n}", "t", *names) for n in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() > 49 and all(list(r)[3:] == names for r in mixed.collect())
    assert mixing.digests(df).count() == 49


def test_the_cut_comes_from_the_sorted_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("at"), (F.col("id") % 5).alias("n"))
    got = mixing.running(df.repartition(9), ["at"], "n").orderBy("at").collect()
    sums, total = [], 0
    for r in got:
        sums.append(total)
        total += r["n"]
    assert [r["before"] for r in got] == sums
