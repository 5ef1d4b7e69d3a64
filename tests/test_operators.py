from __future__ import annotations

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from lodespan import streaming
from lodespan.engine import Engine
from lodespan.functions import text
from lodespan.operators import crawl, frontier, pages, robots, search, vectors
from lodespan.plans import corpus, fixtures
from lodespan.schemas import DOCUMENT_MESSAGE, FRONTIER
from lodespan.sources import tables


def test_robots(spark):
    got = {r["domain"]: (r["disallowed"], r["allowed"], r["crawl_delay_s"]) for r in robots.rules(spark.createDataFrame(fixtures.ROBOTS, "domain string, body string"), "LodespanBot").collect()}
    assert got == {"a.example": (["/charts/", "/logs/"], ["/charts/open/"], 5), "b.example": (["/tides/", "/ferries/"], [], 2), "c.example": ([], [], 2), "d.example": (["/Kept/Case"], [], 7)}


def test_path_rules(spark):
    paths = spark.createDataFrame([(p,) for p in ("/index.html", "/about-us", "/admin/dashboard", "/api/private/users", "/admin/public/images/logo.png")], "p string")
    deny, allow = F.array(F.lit("/admin"), F.lit("/api/private")), F.array(F.lit("/admin/public"))
    assert [r[0] for r in paths.select(robots.can_crawl(F.col("p"), deny, allow)).collect()] == [True, True, False, False, True]


def test_backoff(spark):
    got = spark.range(1).select(*(robots.backoff(F.lit(d), F.lit(e)) for d, e in ((2, 0), (2, 1), (0, 3), (2, 8), (5, 1000)))).first()
    assert tuple(got) == (2, 4, 8, 300, 300)


def test_frontier(spark):
    known = spark.createDataFrame([("https://a.example/", "done"), ("https://a.example/p", "pending"), ("nonsense", "pending")], FRONTIER)
    found = spark.createDataFrame([("https://a.example/",), ("https://b.example/",), ("https://b.example/",), (None,)], "url string")
    added = frontier.add(found, known)
    assert sorted(map(tuple, added.collect())) == [("https://a.example/", "done"), ("https://a.example/p", "pending"), ("https://b.example/", "pending"), ("nonsense", "pending")]
    rules = spark.createDataFrame([("b.example", ["/"], [], 9)], "domain string, disallowed array<string>, allowed array<string>, crawl_delay_s long")
    plan, after = frontier.round_of(added, rules)
    assert [tuple(r) for r in plan.select("url", "number", "start_s").collect()] == [("https://a.example/p", 1, 0)]
    assert dict(map(tuple, after.collect()))["https://b.example/"] == "done" and dict(map(tuple, after.collect()))["nonsense"] == "pending"
    assert frontier.new_urls(found.limit(0), known).count() == 0


def test_schedule_against_recurrence(spark):
    arrivals = [("d", 0, 1), ("d", 1, 2), ("d", 30, 3), ("d", 31, 4), ("e", 5, 5)]
    got = {r["seq"]: r["start_s"] for r in frontier.schedule(spark.createDataFrame(arrivals, "domain string, arrival_s long, seq long").withColumn("crawl_delay_s", F.lit(10).cast("long"))).collect()}
    want, last = {}, {}
    for domain, at, seq in arrivals:
        want[seq] = last[domain] = max(at, last.get(domain, at - 10) + 10)
    assert got == want


def test_native_chunks_equal_walk(spark):
    texts = [(1, "a b c. d e. f. g h i j k. l. m n"), (2, ""), (3, None), (4, "one")]
    parts = F.filter(F.transform(F.split("text", "\\."), text.clean), lambda s: s != "")
    got = {(r["id"], r["chunk_id"]): r["text"] for r in text.chunk_table(spark.createDataFrame(texts, "id long, text string"), "id", parts, 5, 1).collect()}
    want = {}
    for key, value in texts:
        split = [s.strip() for s in (value or "").split(".") if s.strip()]
        want |= {(key, n): " ".join(split[a:b]) for n, (a, b) in enumerate(text.chunk_spans([len(s.split()) for s in split], 5, 1))}
    assert got == want


def test_pages(spark):
    rows = [("https://e.com/a", "text/html", bytearray(b"<title>T</title><p>One two. Three.</p><a href=/b>x</a>")), ("https://e.com/b", "application/pdf", bytearray(b"bad")), ("https://e.com/c", "text/html", None)]
    df = spark.createDataFrame(rows, "url string, mime_type string, content binary")
    parsed = {r["url"]: r for r in pages.parse(df).collect()}
    assert parsed["https://e.com/a"]["title"] == "T" and parsed["https://e.com/b"]["error"] and parsed["https://e.com/c"]["text"] is None
    assert [tuple(r) for r in pages.links(df).collect()] == [("https://e.com/a", "https://e.com/b", "e.com")]
    assert pages.chunks(pages.parse(df)).count() == 1
    assert pages.by_shard(pages.links(df), 3).agg(F.sum("n_links")).first()[0] == 1


def test_vector_messages(spark):
    schema = "url string, title string, description string, chunks array<string>, embeddings array<array<float>>"
    messages = spark.createDataFrame([("a", None, "d", ["x", "y"], [[1.0, 0.0], [0.0, 1.0]]), ("b", None, None, ["x"], [[1.0, 0.0], [0.0, 1.0]]), ("c", None, None, [], []), ("e", None, None, None, None)], schema)
    rows, bad = vectors.rows_of(messages, 2)
    assert [tuple(r) for r in rows.select("url", "description", "chunk_id", "text", "vector").collect()] == [("a", "d", 0, "x", [1.0, 0.0]), ("a", "d", 1, "y", [0.0, 1.0])]
    assert sorted(r["url"] for r in bad.collect()) == ["b", "c", "e"] and bad.first()["reason"] == "Chunks and embeddings length mismatch"


def test_store_and_search(spark):
    body = "word " * 60
    df = spark.createDataFrame([("u1", "t", "d", 0, body, [0.5] * 4), ("u2", None, None, 0, "other words here", [0.1] * 4)], "url string, title string, description string, chunk_id int, text string, vector array<float>")
    top = vectors.nearest(df, [0.5] * 4, 1, ["url", "chunk_id"])
    assert top.first()["url"] == "u1" and top.first()["vector_distance"] == 0
    got = search.search(df, "other", 2, embedder=lambda texts: [[0.5] * 4 for _ in texts]).collect()
    assert [r["url"] for r in got] == ["u2", "u1"] and got[1]["snippet"].endswith("...") and len(got[1]["snippet"]) == 163 and got[1]["text"] == body
    assert [r["url"] for r in search.search(df, "other", 2, embedder=lambda texts: [[0.5] * 4 for _ in texts], reranker=None).collect()] == ["u1", "u2"]
    with pytest.raises(ValueError, match="blank"):
        search.search(df, "  ")


def test_many_queries_equal_single_ones(spark):
    rows = [(i, [float((i * 7) % 5), float(i % 3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    queries = df.where("id % 10 = 0").select(F.col("id").alias("q"), "v")
    got = sorted(map(tuple, vectors.nearest_of_many(df, queries, 3, "id", "q", "v").select("q", "place", "id").collect()))
    want = []
    for q, point in rows[::10]:
        best = sorted(rows, key=lambda r: (sum((a - b) ** 2 for a, b in zip(r[1], point)), r[0]))[:3]
        want += [(q, n, r[0]) for n, r in enumerate(best, 1)]
    assert got == sorted(want)


def test_parse_query(spark):
    got = {r["query"]: r for r in search.parse_query(spark.createDataFrame(fixtures.PHRASES, "query string, language string")).collect()}
    first = got["Running foxes site:example.com the FOREST"]
    assert (first["original_text"], first["site_filter"], first["processed_text"]) == ("Running foxes the FOREST", "example.com", "run fox forest")
    assert got["site:a.example  site:b.example"]["site_filter"] == "b.example" and got["the and of"]["site_filter"] is None


def test_embedding_is_stable(spark):
    made = vectors.embed(spark.createDataFrame([("a b",), ("A  b",), (None,), ("",)], "text string"), lambda: vectors.hashed(8)).collect()
    assert made[0]["vector"] == made[1]["vector"] and made[2]["vector"] is None and made[3]["vector"] == [0.0] * 8


def test_messages_and_stream(spark, tmp_path):
    values = spark.createDataFrame([('{"url":"u","blob_id":"b","mime_type":"m"}',), ("{bad",), ("{}",), (None,)], "value string")
    good, bad = tables.from_messages(values, DOCUMENT_MESSAGE)
    assert good.count() == 1 and bad.count() == 3
    page = spark.createDataFrame([("https://e.com/a", "text/html", bytearray(b"<p>Hello there.</p>"))], "url string, mime_type string, content binary")
    root = f"file://{tmp_path}"
    for _ in range(2):
        messages = tables.store_blobs(page, f"{root}/blobs")
    assert spark.read.parquet(f"{root}/blobs").count() == 1
    tables.to_messages(messages).unionByName(values.where("value = '{bad'")).write.text(f"{root}/messages")
    for _ in range(2):  # the second run finds nothing new
        streaming.ingest(spark, f"{root}/messages", f"{root}/blobs", f"{root}/chunks", f"{root}/dead", f"{root}/checkpoint")
    assert [r["text"] for r in spark.read.parquet(f"{root}/chunks").collect()] == ["Hello there."]
    assert spark.read.parquet(f"{root}/dead").count() == 1


def test_vector_stream(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = spark.createDataFrame([("u", "t", None, i, f"part {i}", [float(i), 1.0]) for i in (1, 0)], "url string, title string, description string, chunk_id int, text string, vector array<float>")
    messages = tables.to_messages(vectors.messages_of(rows))
    odd = spark.createDataFrame([("{bad",), ('{"url":"v","chunks":["a","b"],"embeddings":[[1.0,2.0]]}',), ('{"url":"w","chunks":["a"],"embeddings":[[1.0]]}',)], "value string")
    messages.unionByName(odd).write.text(f"{root}/messages")
    for _ in range(2):
        streaming.index(spark, f"{root}/messages", f"{root}/rows", f"{root}/dead", f"{root}/checkpoint", 2)
    got = spark.read.parquet(f"{root}/rows").orderBy("chunk_id").collect()
    assert [(r["url"], r["title"], r["chunk_id"], r["text"], r["vector"]) for r in got] == [("u", "t", 0, "part 0", [0.0, 1.0]), ("u", "t", 1, "part 1", [1.0, 1.0])]
    assert spark.read.parquet(f"{root}/dead").count() == 3


def test_blocked_domains_wait(spark):
    known = spark.createDataFrame([(f"https://{x}.com/{i}", "pending") for x in "ab" for i in range(2)], FRONTIER)
    rules = spark.createDataFrame([("a.com", [], [], 3)], "domain string, disallowed array<string>, allowed array<string>, crawl_delay_s long")
    blocked = spark.createDataFrame([("a.com", 1050), ("b.com", 900)], "domain string, blocked_until long")
    plan, _ = frontier.round_of(known, rules, blocked, 1000)
    assert sorted((r["url"][8:], r["start_s"]) for r in plan.collect()) == [("a.com/0", 50), ("a.com/1", 53), ("b.com/0", 0), ("b.com/1", 2)]


def test_lost_blobs_are_dead_letters(spark, tmp_path):
    root = f"file://{tmp_path}"
    stored = spark.createDataFrame([("https://e.com/a", "text/html", bytearray(b"<p>Here."))], "url string, mime_type string, content binary")
    messages = tables.store_blobs(stored, f"{root}/blobs")
    lost = spark.createDataFrame([("https://e.com/b", "nowhere", "text/html"), ("https://e.com/c", None, "text/html")], messages.schema)
    tables.to_messages(messages.unionByName(lost)).write.text(f"{root}/messages")
    streaming.ingest(spark, f"{root}/messages", f"{root}/blobs", f"{root}/chunks", f"{root}/dead", f"{root}/checkpoint")
    dead = spark.read.parquet(f"{root}/dead").collect()
    assert len(dead) == 2 and {r["reason"] for r in dead} == {"blob not found"}
    assert spark.read.parquet(f"{root}/chunks").count() == 1


def test_a_round_fetches_each_address_once(spark, tmp_path):
    log = tmp_path / "fetched"
    log.mkdir()

    def factory():
        def one(url):
            (log / f"{time.time_ns()}-{url.rsplit('/', 1)[-1]}").touch()
            return crawl.Fetched(crawl.SUCCESS, b"<a href=/next>x</a>", "text/html")

        return one

    known = spark.createDataFrame([(f"https://e.com/{x}", "pending") for x in "ab"], FRONTIER)
    rules = spark.createDataFrame([], "domain string, disallowed array<string>, allowed array<string>, crawl_delay_s long")
    got, after = crawl.step(known, rules, lambda urls: crawl.fetch(urls, factory))
    assert got.count() == 2 and after.count() == 3 and after.count() == 3
    assert sorted(p.name[-1] for p in log.iterdir()) == ["a", "b"]


def test_vector_table(spark):
    schema = spark.createDataFrame([], "url string, vector array<float>").schema
    spark.sql("drop table if exists vectors_test")
    assert vectors.open_table(spark, "vectors_test", schema).count() == 0
    rows = spark.createDataFrame([("u", [1.0])], schema)
    vectors.append(rows, "vectors_test")
    vectors.append(rows, "vectors_test")
    vectors.append(rows, "vectors_test", dedupe=True)
    assert spark.table("vectors_test").count() == 2


def pretend():
    def fetch_one(url):  # the outcome is in the address
        if "success" in url:
            return crawl.Fetched(crawl.SUCCESS, b"<a href=/next>x</a>", "text/html")
        return crawl.Fetched(crawl.RATE_LIMITED) if "rate-limit" in url else crawl.Fetched(crawl.ERROR, error="no")

    return lambda: fetch_one


def test_fetch_outcomes(spark):
    urls = spark.createDataFrame([(f"https://e.com/{x}",) for x in ("success", "rate-limit", "other")], "url string")
    got = {r["url"][14:]: (r["status"], r["content"] and bytes(r["content"]), r["mime_type"], r["error"]) for r in crawl.fetch(urls, pretend()).collect()}
    assert got == {"success": ("success", b"<a href=/next>x</a>", "text/html", None), "rate-limit": ("rate_limited", None, None, None), "other": ("error", None, None, "no")}
    assert crawl.HttpFetcher(timeout_s=1)("http://127.0.0.1:9/").status == crawl.ERROR


def test_crawl_round(spark):
    known = spark.createDataFrame([(f"https://e.com/{x}", "pending") for x in ("success", "rate-limit", "denied/success")], FRONTIER)
    rules = spark.createDataFrame([("e.com", ["/denied"], [], 3)], "domain string, disallowed array<string>, allowed array<string>, crawl_delay_s long")
    got, after = crawl.step(known, rules, lambda urls: crawl.fetch(urls, pretend()))
    assert [r["url"] for r in got.collect()] == ["https://e.com/success"]
    assert dict(map(tuple, after.collect())) == {"https://e.com/success": "done", "https://e.com/denied/success": "done", "https://e.com/rate-limit": "pending", "https://e.com/next": "pending"}
    bodies = crawl.robots_bodies(spark.createDataFrame([("a", "https://success/robots.txt"), ("b", "https://x/robots.txt")], "domain string, robots_url string"), pretend())
    assert dict(map(tuple, bodies.collect())) == {"a": "<a href=/next>x</a>", "b": None}


def test_engine(spark):
    table = spark.createDataFrame([("u1", 0, None, "d", "green apples", [1.0, 0.0]), ("u2", 0, "t", None, "red pears", [0.0, 1.0])], "url string, chunk_id int, title string, description string, text string, vector array<float>")
    engine = Engine(table, embedder=lambda texts: [[0.9, 0.0] for _ in texts])
    assert [r["url"] for r in engine.knn([0.0, 1.0], 1).collect()] == ["u2"]
    assert [r["url"] for r in engine.search("red pears", 2).collect()] == ["u2", "u1"]
    assert '"title":null' in engine.search_json("apples", 1)[0]
    assert engine.rerank("red", ["a red b", "c"]) == [1.0, 0.0] and engine.rerank("q", ["a", "bb"], lambda: lambda q, t: [len(x) for x in t]) == [1.0, 2.0]
    assert len(Engine(table).embed("x y")) == 384


def test_more_queries_than_a_block(spark, monkeypatch):
    rows = spark.createDataFrame([(n, [float(n % 7), float(n % 5)]) for n in range(60)], "vec_id long, vector array<float>")
    asked = rows.where("vec_id % 6 = 0")
    whole = sorted(map(tuple, vectors.nearest_of_many(rows, asked.withColumnRenamed("vec_id", "query_id"), 3, "vec_id", "query_id").collect()))
    monkeypatch.setattr(vectors, "MOST_QUERIES", 4)
    dealt = sorted(map(tuple, vectors.nearest_of_many(rows, asked.withColumnRenamed("vec_id", "query_id"), 3, "vec_id", "query_id").collect()))
    assert len(whole) == 30 and dealt == whole


def test_pages_of_one_address_keep_their_own_blobs(spark, tmp_path):
    rows = [(1, "https://e.com/a", "<p>one"), (2, "https://e.com/a", "<p>three"), (3, "https://e.com/b", "<p>one"), (4, "https://e.com/b", "<p>one"), (5, "https://e.com/c", None), (6, None, "<p>\u00fc"), (7, "https://e.com/d", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = corpus.blob_join(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(i, url, None if html is None else len(html.encode())) for i, url, html in rows]


@pytest.mark.parametrize("name", ["page_text", "page_titles"])
def test_cut_references_are_as_in_the_sql(spark, tmp_path, name):
    ends = ["&", "&a", "&am", "&amp", "&amp;", "&quo", "&quot", "&quot;", "&lt; x &gt;", " ", ""]
    rows = [(i, "https://e.com/a", f"<html><title>Fog &amp;{end}</title><body><h1>Fog &amp;{end}</h1><script>f(1 && 2)</script><p>x&copy;y &amp;lt; z{end}</p><a href='/b'>b</a></body></html>") for i, end in enumerate(ends)]
    rows += [(90, "https://e.com/b", "<p>no title"), (91, "https://e.com/c", "<title>  </title>"), (92, "https://e.com/d", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r) for r in corpus.QUERIES[name](spark, str(tmp_path)).collect()}
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = set(con.execute(corpus.ORACLES[name]).fetchall())
    assert len(got) == len(rows) and got == want
