from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from lodespan.llm import quality

SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words = "".join(" " if c in SPACE else c for c in text).split(" ")
    words = [w for w in words if w]
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {g for g in grams if grams.count(g) > 1}
    covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), text.count("\n") + 1


def test_statistics(spark):
    chance = random.Random(10)
    texts = [None, "", " \n\t", "a", "a#b $%\n\na#b $%\n a#b $%", "é字 x\x0bz", "a b c d e f g h " * 3, "x " * 40, "one two three four five six seven eight nine one two three four five six seven eight"]
    texts += [" ".join(chance.choices(["a", "b"], k=chance.randint(0, 60))) + "\n" * chance.randint(0, 3) for _ in range(60)]
    df = spark.createDataFrame([(n, t, "clash") for n, t in enumerate(texts)], "id long, text string, size string")
    got = {r["id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["n_lines"]) for r in quality.statistics(df).collect()}
    assert got == {n: brute(t) for n, t in enumerate(texts)}


def test_concentration_equals_numpy(spark):
    chance = np.random.default_rng(11)
    names = list(quality.FEATURES)
    good = chance.multivariate_normal(np.zeros(5), np.diag([4, 1, 0.1, 0.2, 0.3]) + 0.05, 400)
    bad = chance.normal(9, 0.1, (80, 5))
    rows = [("g", *map(float, x)) for x in [*good, *bad]]
    fit = quality.estimates(spark.createDataFrame(rows, ["group", *names])).first()
    data, floors = np.array([r[1:] for r in rows]), np.array(list(quality.FEATURES.values()))
    centre = np.array([sorted(np.round(data[:, i] * 1024))[239] / 1024 for i in range(5)])
    spread = np.array([sorted(np.round(np.abs(data[:, i] - centre[i]) * 1024))[239] / 1024 for i in range(5)])
    starts = [(centre, np.diag(1 / ((1.4826 * spread) ** 2 + floors**2))), (centre, np.diag(1 / floors**2)), (data.mean(axis=0), np.linalg.inv(np.cov(data.T, bias=True) + np.diag(floors**2)))]
    volumes = [None] * 3
    for step in range(quality.MOST_STEPS):
        moved = []
        for k, (centre, precision) in enumerate(starts):
            off = data - centre
            far = np.einsum("ij,jk,ik->i", off, precision, off)
            bins = np.ceil(32 * np.log2(np.maximum(far, 1e-6)))
            near = data[bins <= sorted(bins)[int(np.ceil(0.75 * len(data))) - 1]]
            spread = np.cov(near.T, bias=True) + np.diag(floors**2)
            starts[k], volume = (near.mean(axis=0), np.linalg.inv(spread)), np.linalg.slogdet(spread)[1]
            moved.append(abs(volume - (volumes[k] or 0)))
            volumes[k] = volume
        if step and max(moved) < quality.SETTLED:
            break
    best = int(np.argmin(np.round(volumes, 6)))
    centre, precision = starts[best]
    assert np.allclose(fit["centre"], centre) and np.allclose(np.array(fit["precision"]), precision) and fit["fitted"] == 480
    assert np.isclose(fit["volume"], min(volumes))  # the least determinant of the three
    assert np.abs(np.array(fit["centre"])).max() < 0.5  # the 80 outliers don't move it


def test_steps_never_enlarge_the_determinant_much(spark):
    chance = np.random.default_rng(13)
    names = list(quality.FEATURES)
    rows = spark.createDataFrame([(g, *map(float, x)) for g in "ab" for x in chance.standard_t(2, (300, 5))], ["group", *names])
    now = quality._starts(rows)
    volumes = []
    for _ in range(4):
        now = quality.concentrate(rows, now)
        volumes.append({(r["group"], r["start"]): r["volume"] for r in now.collect()})
    assert len(volumes[0]) == 6
    assert all(after[k] <= before[k] + 0.05 for before, after in zip(volumes, volumes[1:], strict=False) for k in after)


def test_verdicts_stay_when_other_groups_grow(spark):
    random.seed(14)
    text = lambda n: " ".join("".join(random.choices("abcdefgh", k=random.randint(2, 9))) for _ in range(n))
    small = [(n, text(random.choice([30, 60, 200, 3000])) + "#" * (50 * (n % 9 == 0)), "en", "small") for n in range(45)]
    other = [(1000 + n, text(80), "en", "large") for n in range(40)]
    more = other + [(2000 + n, text(300), "en", "large") for n in range(400)]
    schema = "doc_id long, text string, lang string, source string"
    once, again = ({r["doc_id"]: (r["kept"], r["group"], round(r["distance"], 6)) for r in quality.judge(spark.createDataFrame(small + rest, schema)).where("doc_id < 1000").collect()} for rest in (other, more))
    assert once == again and {g for _, g, _ in once.values()} == {"=en/=small"}


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 300_000, "en", "s"), (2, "w" * 1_000_000, "en", "s")], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: (r["n_words"], r["n_repeat_words"], r["word_chars"], r["base_failed"]) for r in quality.judge(df).collect()}
    assert got == {1: (300_000, 300_000, 1_200_000, True), 2: (1, 0, 1_000_000, True)}


def test_judging(spark):
    chance, word = random.Random(12), lambda: "".join(random.choices("abcdefgh", k=5))
    random.seed(12)
    rows = [(n, " ".join(word() for _ in range(chance.randint(60, 200))) + ".", "en", f"s{n % 2}", "k") for n in range(420)]
    rows += [(1000, " ".join(word() + "***" for _ in range(100)), "en", "s0", "k"), (1001, "too short", "en", "s0", "k"), (1002, "same words again and again and so on " * 20, "en", "s0", "k"), (1003, None, "en", "s0", "k"), (1004, " ".join(word() for _ in range(80)), None, None, "k"), (None, rows[0][1], "en", "s0", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert all(got[n]["kept"] for n in range(420)) and got[None]["kept"] and got[1004]["kept"]
    assert not got[1000]["kept"] and not got[1000]["base_failed"]
    assert [(got[n]["base_failed"], got[n]["kept"]) for n in (1001, 1002, 1003)] == [(True, False)] * 3
    assert got[0]["group"] == "=en/=s0" and got[1004]["group"] == "*"
    assert quality.judge(df.limit(0)).count() == 0
    assert quality.judge(df.where("doc_id = 1001")).first()["kept"] is False


def test_rest_groups_are_bounded(spark):
    rows = [(n, "x", "l" + str(n % 3), f"s{n}") for n in range(900)]
    df = spark.createDataFrame(rows, "key long, text string, lang string, source string")
    assert {r["group"]: r["n"] for r in quality._grouped(df, "lang", "source").groupBy("group").agg(F.count("*").alias("n")).collect()} == {"=l0": 300, "=l1": 300, "=l2": 300}


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "x", "en", "s")], "doc_id long, text string, lang string, source string")
    plan = quality.statistics(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_groups_do_not_depend_on_the_rest(spark):
    source = F.when(F.col("id") < 250, "small").otherwise("large")
    rows = spark.range(300_000).select(F.lit("en").alias("lang"), source.alias("source"))
    assert {r["group"]: r["count"] for r in quality._grouped(rows, "lang", "source").groupBy("group").count().collect()} == {"=en/=small": 250, "=en/=large": 299_750}
