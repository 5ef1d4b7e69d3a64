from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodespan.llm import linededup

BLANK = " \t\n\x0b\x0c\r"


def brute(rows, min_length, min_documents):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))

    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_length and doc is not None:
                holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = [len(holders.get(key(x), ())) >= min_documents and doc != max(holders[key(x)]) for x in lines]
        out.append((doc, "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone), [g for g in gone]))
    return out


def runs_to_flags(runs):
    return [bool(i % 2) for i, n in enumerate(runs) for _ in range(n)]


def test_equals_brute_force(spark):
    chance = random.Random(9)
    pool = ["Short", "a line that is long enough to count 1", " A LINE that is long enough to count 1\r", "ünïcode line that is long enough", "", "\x0b another long enough line here \x0c", "rare but long enough line of text"]
    rows = [(n, "\n".join(chance.choices(pool[:6], k=chance.randint(0, 7)))) for n in range(40)]
    rows += [(41, pool[6]), (42, None), (43, ""), (44, "\n\n"), (5, pool[1]), (5, pool[1]), (5, rows[5][1]), (None, pool[1] + "\nown"), (50, "\n".join([pool[1]] * 3000 + ["end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_lines": F.lit("x"), "hash": F.lit(1), "_doc2": F.lit(2)})
    out = linededup.deduplicate(df, min_length=20, min_documents=3)
    assert out.columns == ["doc_id", "text", "hash", "_doc2", "n_lines", "n_dropped", "keep_runs"]
    got = sorted(((r["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"], runs_to_flags(r["keep_runs"])) for r in out.collect()), key=str)
    assert got == sorted(brute(rows, 20, 3), key=str)
    assert out.where("doc_id = 42").first()["text"] is None


def test_nothing_repeated_and_empty(spark):
    df = spark.createDataFrame([(1, "x" * 50), (2, "y" * 50)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_dropped"]) for r in linededup.digests(df).collect()) == [(1, 0), (2, 0)]
    assert linededup.digests(df.limit(0)).count() == 0


def test_bitmaps_carry_no_text(spark):
    df = spark.createDataFrame([(n, "z" * 60 + "\nown") for n in range(6)], "doc_id long, text string")
    bitmaps = linededup.keep_bitmaps(df)
    assert bitmaps.columns == ["doc", "print", "gone"] and sorted((r["doc"], r["gone"]) for r in bitmaps.collect()) == [(n, [(0, 1)]) for n in range(5)]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = linededup.digests(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "rangepartitioning" in plan


def test_runs_are_merged(spark):
    text = "\n".join(["z" * 60] * 3 + ["own"] + ["y" * 60] * 2)
    df = spark.createDataFrame([(n, text) for n in range(6)], "doc_id long, text string")
    assert linededup.keep_bitmaps(df).where("doc = 0").first()["gone"] == [(0, 3), (4, 2)]
    assert linededup.deduplicate(df).where("doc_id = 0").first()["keep_runs"] == [0, 3, 1, 2, 0]


def test_occurrences_are_streamed_in_order(spark):
    """The windows take the range partitioning and its order as they are: by hash, document and position."""
    df = spark.createDataFrame([(n, "z" * 60) for n in range(6)], "doc_id long, text string")
    hashed = linededup.cut(linededup.hashed_lines(df))
    plan = linededup.streamed(hashed, linededup.hot_hashes(hashed))._jdf.queryExecution().executedPlan().toString().split("\n")
    steps = [line for line in plan if any(x in line for x in ("Window", "Sort ", "Exchange"))]
    kinds = ["Window" if "Window" in x else "Sort" if "Sort " in x else "Exchange" for x in steps]
    last = max(i for i, k in enumerate(kinds) if k == "Window")
    assert kinds[last + 1 : last + 3] == ["Sort", "Exchange"] and "rangepartitioning" in steps[last + 2] and set(kinds[: last + 1]) == {"Window"}
    assert steps[last + 1].index("hash") < steps[last + 1].index("salt") < steps[last + 1].index("doc") < steps[last + 1].index("at#")


def test_columns_of_any_name_and_a_very_long_text(spark):
    names = ["_doc", "_print", "_gone", "_row", "_parts", "parts", "doc", "print", "hash", "a.b", "c0"]
    rows = [(n, "z" * 60 + "\n" + f"own {n} " * (300_000 if n == 3 else 1), *names) for n in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    out = linededup.deduplicate(df)
    assert out.columns == ["doc_id", "text", *names, "n_lines", "n_dropped", "keep_runs"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(list(r)[2 : 2 + len(names)] == names for r in got.values())
    assert {n: r["text"] for n, r in got.items()} == {r[0]: r[1] if r[0] == 5 else r[1].split("\n")[1] for r in rows}
    assert linededup.deduplicate(df.limit(0)).columns == out.columns and linededup.deduplicate(df.limit(0)).count() == 0
