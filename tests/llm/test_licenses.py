from __future__ import annotations

import duckdb

from lodespan.llm import licenses


def rows():
    mit = licenses.TEXTS["MIT"]
    body = mit.partition("\n\n")[2]
    return [
        (1, "MIT License\n\nCopyright (c) 2020 Some One\n\n" + body),
        (2, body.upper().replace("SOFTWARE", "  software\t")),
        (3, "// " + body.replace("\n", "\n// ").replace("sublicense", "sublicence")),
        (4, body + " but not this"),
        (5, None),
        (6, ""),
        (7, "text\nReleased under the MIT License.\nmore\nreleased under the mit licence\nLicensed under CC BY-NC 4.0."),
        (8, licenses.TEXTS["Unlicense"].replace("non-commercial", "noncommercial")),
        (1, "MIT License\n\nCopyright (c) 2020 Some One\n\n" + body),
    ]


def test_scan(spark):
    df = spark.createDataFrame([(*r, "clash") for r in rows()], "doc_id long, text string, license string")
    out = licenses.scan(df)
    assert out.columns == ["doc_id", "text", "license_digest", "license"]
    assert sorted((r["doc_id"], r["license"]) for r in out.collect()) == [(1, "MIT"), (1, "MIT"), (2, "MIT"), (3, "MIT"), (4, None), (5, None), (6, None), (7, None), (8, "Unlicense")]
    assert sorted(map(tuple, licenses.notices(df).collect())) == [(7, "CC-BY-NC-4.0", 1), (7, "MIT", 2)]
    assert licenses.scan(df.limit(0)).count() == 0


def test_own_table_and_ties(spark):
    known = spark.createDataFrame([(1, "Some words!")], "i long, text string").select(licenses.digest(licenses.canonical(licenses.F.col("text"))).alias("digest"))
    known = known.selectExpr("digest", "explode(array('b', 'a')) license")
    out = licenses.scan(spark.createDataFrame([(1, "some WORDS")], "doc_id long, text string"), known)
    assert [r["license"] for r in out.collect()] == ["a"]


def test_equals_its_sql(spark):
    df = spark.createDataFrame([r for r in rows()[:8]], "doc_id long, text string")
    con = duckdb.connect()
    documents = df.toPandas()  # noqa: F841
    con.register("documents", documents)
    want = sorted(con.sql(f"SELECT doc_id, license_digest, license, notices FROM ({licenses.sql()})").fetchall(), key=str)
    assert sorted((tuple(r) for r in licenses.digests(df).select("doc_id", "license_digest", "license", "notices").collect()), key=str) == want


def test_every_text_is_its_own(spark):
    known = licenses.known_texts(spark).collect()
    assert len({r["digest"] for r in known}) == len(known)


def test_long_texts_names_before_years_and_more_notices(spark):
    gpl, mit = licenses.TEXTS["GPL-3.0-only"], licenses.TEXTS["MIT"].partition("\n\n")[2]
    texts = [gpl, gpl[: gpl.index("END OF TERMS")], licenses.TEXTS["Apache-2.0"].upper(), licenses.TEXTS["MPL-2.0"], "Copyright Jane Doe 2020\n\n" + mit, "# Copyright Jane Doe, 2019-2020. All rights reserved.\n" + mit, "copyright law of 1976 applies\n" + mit]
    df = spark.createDataFrame(list(enumerate([*texts, "# SPDX-License-Identifier: LGPL-2.1-or-later\nThis project is licensed under the Apache 2.0 License"])), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.digests(df).collect()}
    assert [got[n]["license"] for n in range(8)] == ["GPL-3.0-only", "GPL-3.0-only", "Apache-2.0", "MPL-2.0", "MIT", "MIT", None, None]
    assert got[7]["notices"] == "Apache-2.0,LGPL-2.1-or-later"


def test_neighbouring_spellings(spark):
    rows = [("licence licence licence", "license license license"), ("per cent, per cent per cent", "percent percent percent"), ("sub-licence Sub licence", "sublicense sublicense"), ("élicence licence's", "élicence license s"), ("", ""), (None, "")]
    df = spark.createDataFrame(rows, "text string, wanted string")
    assert all(r[0] == (f" {r[1]} " if r[1] else " ") for r in df.select(licenses.canonical(licenses.F.col("text")), "wanted").collect())
    got = duckdb.sql("SELECT " + licenses._sql_canonical("text") + " FROM (VALUES " + ", ".join(f"({licenses._sql_text(t)})" for t, _ in rows if t is not None) + ") AS t(text)").fetchall()
    assert [g[0].strip() for g in got] == [w for t, w in rows if t is not None]


def test_a_very_long_text_and_odd_names(spark):
    df = spark.createDataFrame([(1, "licence " * 300_000, "x", "y"), (2, licenses.TEXTS["MIT"], "x", "y")], "doc_id long, text string, `a.b` string, digest string")
    out = licenses.scan(df)
    assert out.columns == [*df.columns, "license_digest", "license"] and {r["doc_id"]: r["license"] for r in out.collect()} == {1: None, 2: "MIT"}
