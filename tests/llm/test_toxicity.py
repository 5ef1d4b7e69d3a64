from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodespan.llm import toxicity


def entries(chance, n, terms, groups=1):
    """Distinct vectors; each has coordinates of one of the groups that the terms are dealt to."""
    out = {}
    for i in range(n):
        own = range(i % groups, terms, groups)
        at = tuple(sorted(chance.sample(own, chance.randint(1, 5))))
        w = np.array([chance.randint(1, 9) for _ in at], float)
        w = (w / np.linalg.norm(w)).astype(np.float32)
        out[at, tuple(w)] = (np.array(at, np.int32), w, chance.random(), 1.0, chance.randint(1, 4), i)
    return list(out.values())


def dense(at, weights, terms):
    out = np.zeros(terms)
    out[at] = weights
    return out


@pytest.mark.parametrize(("n", "terms"), [(1, 6), (40, 6), (700, 25)])
def test_index_is_exact(n, terms):
    chance = random.Random(15)
    rows = entries(chance, n, terms)
    index = toxicity.Index(rows, terms)
    for at, weights, *_ in entries(chance, 60, terms):
        query = dense(at, weights, terms)
        cosines = sorted(((float(dense(r[0], r[1], terms) @ query), r[5], r[4]) for r in rows), key=lambda x: -x[0])
        cosines, have, least = [c for c in cosines if c[0] > 0], 0, None
        for c in cosines:
            have += c[2]
            if have >= 10:
                least = c[0]
                break
        want = {c[1] for c in cosines if least is None or c[0] >= least - 1e-9}
        found, scores = index.nearest(at, weights, 10)
        assert set(index.ids[found].tolist()) == want
        assert np.allclose(scores, [c[0] for c in cosines[: len(scores)]])
    assert len(index.nearest(np.empty(0, np.int32), np.empty(0, np.float32), 10)[0]) == 0


def test_bounds_spare_blocks():
    chance = random.Random(19)
    index = toxicity.Index(entries(chance, 6000, 120, groups=8), 120)
    scored = touched = 0
    for at, weights, *_ in entries(chance, 100, 120, groups=8):
        index.nearest(at, weights, 5)
        scored += index.scored
        index.nearest(at, weights, 1 << 30)  # all blocks with a term in common
        touched += index.scored
    assert touched < 0.4 * 100 * index.blocks and scored < 0.9 * touched


def test_whole_score_by_brute_force(spark):
    """Term weights, neighbours, leave-one-out votes, calibration and scores, from their definitions."""
    documents, labels = corpus(spark, 400)
    labels = labels.where("doc_id < 400")  # with every example's text both labels weigh alike
    model = toxicity.fit(documents, labels)
    label = {r["doc_id"]: r["toxic"] for r in labels.where("toxic is not null").collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    fit = sorted(n for n in label if n in texts and zlib.crc32(str(n).encode()) % 4 != 2)
    words = {n: [t for w in re.findall(r"\w+", texts[n].lower()) for t in toxicity.terms_of(w)] for n in texts}
    held = Counter(t for n in fit for t in set(words[n]))
    best = None
    for floor in toxicity.FLOORS:
        names = sorted(t for t, k in held.items() if k >= 2 and k / len(fit) <= floor)
        number, idf = {t: i for i, t in enumerate(names)}, -np.log(np.array([held[t] for t in names]) / len(fit))

        def vector(n, number=number, idf=idf):
            tf = np.zeros(len(number))
            for t in words[n]:
                if t in number:
                    tf[number[t]] += 1
            return tf * idf / (np.linalg.norm(tf * idf) or 1)

        known = np.array([vector(n) for n in fit])
        toxic = np.array([label[n] for n in fit], float)

        def vote(query, wanted, without=None, known=known, toxic=toxic):
            cosines = known @ query
            if without is not None:
                cosines[without] = 0
            if not (cosines > 0).any():
                return None
            near = (cosines > 0) & (cosines >= np.sort(cosines)[-min(len(cosines), wanted)] - 1e-6)
            return cosines[near] @ toxic[near] / cosines[near].sum()

        blank = [y for v, y in zip(known, toxic, strict=True) if not v.any()]
        blank = float(np.mean(blank)) if blank else 0.0
        for wanted in toxicity.NEIGHBOURS:
            own = [vote(known[i], wanted, i) for i in range(len(fit))]
            steps = toxicity.isotonic([(round(v, 12), y, 1.0) for v, y in zip(own, toxic, strict=True) if v is not None])
            guess = lambda v, steps=steps, blank=blank: blank if v is None else float(toxicity.calibrated(steps, v))
            error = sum((guess(v) - y) ** 2 for v, y in zip(own, toxic, strict=True))
            if best is None or error < best[0]:
                best = (error, {n: guess(vote(vector(n), wanted)) for n in texts}, len(names), wanted)
    assert (len(model.vectors.idf), model.neighbours) == best[2:]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(documents, model).collect()}
    off = [n for n in texts if abs(got[n] - best[1][n]) > 1e-6]
    assert len(off) <= 0.02 * len(texts), [(n, got[n], best[1][n]) for n in off][:20]  # votes next to a step's edge may fall to either side


def test_nearly_all_documents_have_terms(spark):
    base = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{base}/documents.parquet")
    model = toxicity.fit(documents, spark.read.parquet(f"{base}/labels.parquet"))
    texts = [r["text"] for r in documents.collect()]
    assert sum(not len(model.vectors.vector(t)[0]) for t in texts) < 0.01 * len(texts)


def test_columns_of_any_name(spark):
    documents, labels = corpus(spark, 120)
    odd = documents.withColumns({"evidence": F.lit(1), "a.b": F.lit("x"), "c0": F.lit(2), "toxic": F.lit(3), "at": F.lit(4)})
    kept = toxicity.clean(odd, labels)
    assert kept.columns == odd.columns and {(r["a.b"], r["c0"], r["score"] in ("clash", "c")) for r in kept.collect()} == {("x", 2, True)}
    scored = toxicity.score(odd, toxicity.fit(odd, labels))
    assert scored.columns == ["doc_id", "a.b", "c0", "toxic", "at", "score", "evidence"] and scored.count() == odd.count()


def test_very_long_text_and_repeated_ids(spark):
    documents, labels = corpus(spark, 300)
    long = spark.createDataFrame([(1000, "word1x vilething nastybit " * 100_000, "c"), (1000, "foulest", "c")], documents.schema)
    labelled = labels.unionByName(spark.createDataFrame([(1000, 1), (1000, 0)], labels.schema))
    got = toxicity.digests(documents.unionByName(long), labelled).where("doc_id = 1000").collect()
    assert len(got) == 2 and max(r["score"] for r in got) >= 0.3


def test_isotonic_steps():
    chance = random.Random(16)
    points = [(x := chance.random(), float(chance.random() < x), 1.0) for _ in range(600)]
    starts, values = toxicity.isotonic(points)
    assert (np.diff(values) > 0).all() and (np.diff(starts) > 0).all() and values[0] < 0.2 and values[-1] > 0.8
    assert toxicity.isotonic([])[1].tolist() == [0]


def corpus(spark, n=700):
    chance = random.Random(17)
    words, bad = [f"word{i}x" for i in range(400)], ["vilething", "nastybit", "foulest"]
    rows = []
    for i in range(n):
        toxic = i % 5 == 0
        text = chance.choices(words, k=chance.randint(20, 60)) + (chance.choices(bad, k=3) if toxic else [])
        chance.shuffle(text)
        rows.append((i, " ".join(text), int(toxic)))
    documents = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(n, None, "c"), (n + 1, "", "c"), (n, None, "c")], "doc_id long, text string, score string")
    return documents, spark.createDataFrame([(i, y) for i, _, y in rows] + [(99999, 1), (3, None)], "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    documents, labels = corpus(spark)
    got = toxicity.digests(documents, labels).join(labels.where("toxic is not null"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100 and all(r["predicted"] == r["toxic"] for r in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    toxic = next(r for r in held if r["toxic"])
    assert 1 <= len(toxic["evidence"]) <= 3 and toxic["evidence"][0]["toxic"] == 1.0


def test_labels_of_held_out_rows_change_nothing(spark):
    documents, labels = corpus(spark, 300)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    once, again = (sorted((r["doc_id"], r["score"]) for r in toxicity.digests(documents, x).collect()) for x in (labels, turned))
    assert once == again


def test_edges(spark):
    documents, labels = corpus(spark, 300)
    out = toxicity.digests(documents, labels)
    blank = out.where("doc_id >= 300").collect()
    assert len(blank) == 3 and len({r["score"] for r in blank}) == 1 and blank[0]["predicted"] == 0
    kept = toxicity.clean(documents, labels)
    assert kept.columns == documents.columns and 230 <= kept.count() <= 245
    for some in (labels.limit(0), labels.where("toxic = 0")):
        assert {r["predicted"] for r in toxicity.digests(documents, some).collect()} == {0}
    assert toxicity.digests(documents.limit(0), labels).count() == 0


def test_few_examples_suffice(spark):
    chance, words = random.Random(18), [f"word{i}x" for i in range(400)]
    rows = [(i, " ".join(chance.choices(words, k=30) + (["vilething"] if i % 12 == 0 else [])), int(i % 12 == 0)) for i in range(84)]
    documents, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    fitted = sum(r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2)
    assert 3 <= fitted <= 6
    got = {r["doc_id"]: r["predicted"] for r in toxicity.digests(documents, labels).collect()}
    assert sum(got[r[0]] != r[2] for r in rows) <= 2 and all(got[r[0]] == 0 for r in rows if not r[2])


@pytest.mark.parametrize(("size", "found", "flagged"), [("sf0.001", 1, 2), ("sf0.01", 9, 4)])
def test_recall_at_small_sizes(spark, size, found, flagged):
    base = f"/root/testdata/{size}"
    labels = spark.read.parquet(f"{base}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    rows = toxicity.digests(spark.read.parquet(f"{base}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] for r in rows if r["toxic"]) >= found
    assert sum(r["predicted"] for r in rows if not r["toxic"]) <= flagged
