"""Queries over the search corpus tables; each is an operator applied to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodespan import streaming
from lodespan.functions import stem, text, urls
from lodespan.operators import crawl, frontier, pages, robots, search, vectors
from lodespan.plans import fixtures
from lodespan.session import cut, make_importable, scratch, table
from lodespan.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


_DISTANCE = "list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: (v.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) * (v.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE)))"
_CLEAN = r"trim(regexp_replace(text, '[\s\p{Z}\x0B\x{85}]+', ' ', 'g'), ' ')"
_HOST = "nullif(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '')"
_SNIPPET = "CASE WHEN length(text) > 160 THEN substring(text, 1, 160) || '...' ELSE text END"


def _vector_zero(spark: SparkSession, base: str) -> list[float]:
    return table(spark, base, "embeddings").where("vec_id = 0").select("embedding").first()[0]


# ---- nearest neighbours


@query("knn_search", f"""
WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), top AS (
  SELECT v.vec_id, {_DISTANCE} AS d FROM embeddings v, q WHERE v.vec_id IN (SELECT doc_id FROM documents) ORDER BY d, v.vec_id LIMIT 5)
SELECT 'doc/' || doc_id AS url, text, round(d, 6) AS vector_distance, {_SNIPPET} AS snippet FROM top JOIN documents ON vec_id = doc_id
""")  # fmt: skip
def knn_search(spark: SparkSession, base: str) -> DataFrame:
    """The five documents nearest to vector 0 with snippets; texts are read for these five only."""
    documents = table(spark, base, "documents")
    stored = table(spark, base, "embeddings").join(documents.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    top = vectors.nearest(stored, _vector_zero(spark, base), 5, ["vec_id"], "embedding")
    found = documents.join(F.broadcast(top), F.col("doc_id") == F.col("vec_id"))  # five rows
    return found.select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("url"), "text", F.round("vector_distance", 6).alias("vector_distance"), text.snippet(F.col("text")).alias("snippet"))


@query("knn_topk_l2", f"WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0) SELECT v.vec_id, round({_DISTANCE}, 6) AS vector_distance FROM embeddings v, q ORDER BY {_DISTANCE}, v.vec_id LIMIT 10")
def knn_topk_l2(spark: SparkSession, base: str) -> DataFrame:
    top = vectors.nearest(table(spark, base, "embeddings"), _vector_zero(spark, base), 10, ["vec_id"], "embedding")
    return top.select("vec_id", F.round("vector_distance", 6).alias("vector_distance"))


@query("knn_topk_all_queries", f"""
SELECT query_id, vec_id, round(d, 6) AS vector_distance, place FROM (
  SELECT q.vec_id AS query_id, v.vec_id, {_DISTANCE} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DISTANCE}, v.vec_id)::INT AS place
  FROM embeddings v, (FROM embeddings WHERE vec_id % 100 = 0) q) WHERE place <= 5
""")  # fmt: skip
def knn_topk_all_queries(spark: SparkSession, base: str) -> DataFrame:
    stored = table(spark, base, "embeddings")
    asked = stored.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    top = vectors.nearest_of_many(stored, asked, 5, "vec_id", "query_id", "embedding")
    return top.select("query_id", "vec_id", F.round("vector_distance", 6).alias("vector_distance"), "place")


# ---- texts


@query("clean_text", f"SELECT doc_id, {_CLEAN} AS cleaned FROM documents")
def clean_text(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query("snippet_160", f"SELECT doc_id, {_SNIPPET} AS snippet FROM documents")
def snippet_160(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query("word_counts", f"SELECT doc_id, CASE WHEN {_CLEAN} = '' THEN 0 ELSE len(string_split({_CLEAN}, ' ')) END::INT AS words FROM documents")
def word_counts(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


_PARTS = r"list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda s: trim(regexp_replace(s, '[\s\p{Z}]+', ' ', 'g'), ' ')), lambda s: s <> '')"


_CHUNKS = f"""
WITH RECURSIVE parts AS (SELECT doc_id, {_PARTS} AS p FROM documents),
one AS (SELECT doc_id, unnest(p || ['']) AS sentence, unnest(range(0, len(p) + 1)) AS i, len(p) AS n FROM parts WHERE len(p) > 0),
summed AS (SELECT doc_id, i, n, coalesce(sum(CASE WHEN i < n THEN len(string_split(sentence, ' ')) END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM one),
reach AS (SELECT doc_id, i, n, greatest(i + 1, max(i) OVER (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 200 FOLLOWING)) AS stop FROM summed),
steps AS (SELECT doc_id, i, n, stop, CASE WHEN stop = n THEN n ELSE greatest(i + 1, stop - 2) END AS next FROM reach WHERE i < n),
walk AS (SELECT doc_id, i, stop, next, 0 AS chunk_id FROM steps WHERE i = 0 UNION ALL SELECT s.doc_id, s.i, s.stop, s.next, w.chunk_id + 1 FROM walk w JOIN steps s ON s.doc_id = w.doc_id AND s.i = w.next)
SELECT w.doc_id, w.chunk_id::INT AS chunk_id, w.i::INT AS first, (w.stop - 1)::INT AS last, array_to_string(p[w.i + 1 : w.stop], ' ') AS text FROM walk w JOIN parts USING (doc_id)
"""


@query("chunk_sentences", _CHUNKS)
def chunk_sentences(spark: SparkSession, base: str) -> DataFrame:
    """Overlapping chunks over sentences that a pattern separates, with DataFrame functions only."""
    parts = F.filter(F.transform(F.split("text", "[.!?\n]+", -1), text.clean), lambda s: s != "")
    return text.chunk_table(table(spark, base, "documents"), "doc_id", parts)


@query("chunks_per_document", f"SELECT doc_id, count(*)::BIGINT AS chunks FROM ({_CHUNKS}) GROUP BY doc_id")
def chunks_per_document(spark: SparkSession, base: str) -> DataFrame:
    return chunk_sentences(spark, base).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))


@query("chunk_documents")
def chunk_documents(spark: SparkSession, base: str) -> DataFrame:
    """Overlapping chunks over standard sentences."""
    made = text.chunks(table(spark, base, "documents").select("doc_id", "text"))
    return made.select("doc_id", F.posexplode("chunks").alias("chunk_id", "text"))


@query("chunk_counts", "SELECT doc_id, count(*)::BIGINT AS sentences FROM (SELECT doc_id, unnest(" + _PARTS + ") AS s FROM documents) GROUP BY doc_id")
def chunk_counts(spark: SparkSession, base: str) -> DataFrame:
    parts = F.filter(F.transform(F.split("text", "[.!?\n]+", -1), text.clean), lambda s: s != "")
    return table(spark, base, "documents").select("doc_id", F.explode(parts)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"))


# ---- pages and links


@query("page_hosts", f"SELECT {_HOST} AS domain, count(*)::BIGINT AS pages FROM pages GROUP BY 1")
def page_hosts(spark: SparkSession, base: str) -> DataFrame:
    return tables.pages(spark, base).groupBy(urls.host(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


@query("robots_urls", f"SELECT DISTINCT regexp_extract(url, '^(https?)', 1) || '://' || {_HOST} || '/robots.txt' AS robots_url FROM pages")
def robots_urls(spark: SparkSession, base: str) -> DataFrame:
    return tables.pages(spark, base).select(urls.robots_url(F.col("url")).alias("robots_url")).distinct()


@query("page_titles", r"SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title FROM pages")
def page_titles(spark: SparkSession, base: str) -> DataFrame:
    """Titles as they are written, as the SQL has them."""
    return pages.parse(tables.pages(spark, base), written=True).select("page_id", "title")


# A script's body is text; what looks like a tag in it is hidden while the tags are cut away.
_NODES = r"""regexp_extract_all(replace(regexp_replace(html, '<!--.*?-->', '<x>', 'g'), '"</p>"', '"' || chr(1) || '"'), '>([^<]+)', 1)"""


@query("page_text", f"""
SELECT page_id, replace(replace(replace(replace(replace(replace(replace(array_to_string({_NODES}, ' '), chr(1), '</p>'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS text,
  nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title, NULL::VARCHAR AS description, NULL::VARCHAR AS error FROM pages
""")  # fmt: skip
def page_text(spark: SparkSession, base: str) -> DataFrame:
    """Text and title as they are written, as the SQL has them; `pages.parse` follows the HTML standard otherwise."""
    return pages.parse(tables.pages(spark, base), written=True).select("page_id", "text", "title", "description", "error")


_LINKS = r"""
SELECT DISTINCT page_id, url AS src_url, regexp_extract(url, '^(https?://[^/?#]+)', 1) || replace(replace(replace(url_encode(href), '%2F', '/'), '%2C', ','), '%3A', ':') AS dst_url
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS href FROM pages)
"""


@query("page_links", f"SELECT src_url, dst_url FROM ({_LINKS}) WHERE dst_url <> regexp_replace(src_url, '#.*$', '')")
def page_links(spark: SparkSession, base: str) -> DataFrame:
    return pages.links(tables.pages(spark, base)).select("src_url", "dst_url")


@query("links_by_domain", f"SELECT regexp_extract(dst_url, '^https?://([^/:?#]+)', 1) AS dst_domain, count(*)::BIGINT AS links, count(DISTINCT dst_url)::BIGINT AS targets FROM ({_LINKS}) GROUP BY 1")
def links_by_domain(spark: SparkSession, base: str) -> DataFrame:
    return pages.links(tables.pages(spark, base)).groupBy("dst_domain").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("dst_url").alias("targets"))


@query("link_graph_degree", f"""
WITH l AS ({_LINKS}), i AS (SELECT dst_url AS url, count(*) AS n FROM l GROUP BY 1), o AS (SELECT src_url AS url, count(*) AS n FROM l GROUP BY 1)
SELECT coalesce(i.url, o.url) AS url, coalesce(i.n, 0)::BIGINT AS in_degree, coalesce(o.n, 0)::BIGINT AS out_degree FROM i FULL JOIN o ON i.url = o.url
""")  # fmt: skip
def link_graph_degree(spark: SparkSession, base: str) -> DataFrame:
    """In- and out-degree of every page and target: both ends of an edge in one aggregation."""
    found = pages.links(tables.pages(spark, base))
    ends = found.select(F.explode(F.array(F.struct(F.col("dst_url").alias("url"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src_url").alias("url"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    return ends.groupBy("e.url").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


@query("link_shards", f"SELECT (('0x' || substring(md5(regexp_extract(dst_url, '^https?://([^/:?#]+)', 1)), 1, 8))::BIGINT % 4)::INT AS shard, count(*)::BIGINT AS n_links FROM ({_LINKS}) GROUP BY 1")
def link_shards(spark: SparkSession, base: str) -> DataFrame:
    return pages.by_shard(pages.links(tables.pages(spark, base)), 4)


@query("mime_kinds", "SELECT * FROM (VALUES ('text/html', 'html'), ('application/xhtml+xml', 'xml'), ('application/pdf; q=1', 'pdf'), ('TEXT/XML', 'html')) AS t(mime_type, kind)")
def mime_kinds(spark: SparkSession, base: str) -> DataFrame:
    rows = spark.createDataFrame([("text/html",), ("application/xhtml+xml",), ("application/pdf; q=1",), ("TEXT/XML",)], "mime_type string")
    return rows.select("mime_type", pages.kind(F.col("mime_type")).alias("kind"))


def _contents(spark: SparkSession) -> DataFrame:
    rows = [("https://island.test/sitemap.xml", "application/xml", bytearray(fixtures.SITEMAP.encode())), ("https://example.com/feed", "text/xml", bytearray(fixtures.FEED.encode())), ("https://example.com/a_short-paper.pdf", "application/pdf", bytearray(fixtures.PDF))]
    return spark.createDataFrame(rows, "url string, mime_type string, content binary")


@query("sitemap_links", "SELECT * FROM (VALUES ('https://island.test/sitemap.xml', 'https://island.test/ferries'), ('https://island.test/sitemap.xml', 'https://island.test/tides/today'), ('https://example.com/feed', 'https://example.com/'), ('https://example.com/feed', 'https://example.com/one'), ('https://example.com/a_short-paper.pdf', 'https://example.com/from-pdf')) AS t(src_url, dst_url)")
def sitemap_links(spark: SparkSession, base: str) -> DataFrame:
    """Links of a sitemap, a feed and a PDF."""
    make_importable(spark)
    return pages.links(_contents(spark)).select("src_url", "dst_url")


@query("xml_pdf_documents", "SELECT * FROM (VALUES ('https://island.test/sitemap.xml', '2024 https://island.test/ferries tides/today', NULL, NULL), ('https://example.com/feed', 'News & more https://example.com/ All One https://example.com/one <b>First</b>', 'News & more', 'All'), ('https://example.com/a_short-paper.pdf', 'Hello from a page', 'a short paper', 'A (short) paper')) AS t(url, text, title, description)")
def xml_pdf_documents(spark: SparkSession, base: str) -> DataFrame:
    make_importable(spark)
    return pages.parse(_contents(spark)).select("url", "text", "title", "description")


@query("fallback_titles", r"SELECT page_id, nullif(translate(replace(regexp_extract(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '([^/]*)$', 1), '.pdf', ''), '-_', '  '), '') AS title FROM pages")
def fallback_titles(spark: SparkSession, base: str) -> DataFrame:
    return tables.pages(spark, base).select("page_id", urls.fallback_title(F.col("url")).alias("title"))


# ---- robots and the frontier


@query("robots_rules", "SELECT * FROM (VALUES ('a.example', ['/charts/', '/logs/'], ['/charts/open/'], 5::BIGINT, true), ('b.example', ['/tides/', '/ferries/'], []::VARCHAR[], 2::BIGINT, true), ('c.example', []::VARCHAR[], []::VARCHAR[], 2::BIGINT, true), ('d.example', ['/Kept/Case'], []::VARCHAR[], 7::BIGINT, true)) AS t(domain, disallowed, allowed, crawl_delay_s, rules_fetched)")
def robots_rules(spark: SparkSession, base: str) -> DataFrame:
    return robots.rules(spark.createDataFrame(fixtures.ROBOTS, "domain string, body string"), fixtures.AGENT)


def _frontier(spark: SparkSession) -> DataFrame:
    rows = [(f"https://{domain}{path}", frontier.PENDING) for domain, _ in fixtures.ROBOTS for path in fixtures.PATHS]
    return spark.createDataFrame(rows, "url string, status string")


_RULES = "(VALUES ('a.example', ['/charts/', '/logs/'], ['/charts/open/']), ('b.example', ['/tides/', '/ferries/'], []), ('c.example', [], []), ('d.example', ['/Kept/Case'], [])) AS r(domain, disallowed, allowed)"


@query("frontier_allowed", f"""
SELECT 'https://' || domain || path AS url, domain, (len(list_filter(allowed::VARCHAR[], lambda p: starts_with(path, p))) > 0 OR len(list_filter(disallowed::VARCHAR[], lambda p: starts_with(path, p))) = 0) AS allowed_to_crawl
FROM {_RULES}, (VALUES {', '.join(f"('{p}')" for p in fixtures.PATHS)}) AS p(path)
""")  # fmt: skip
def frontier_allowed(spark: SparkSession, base: str) -> DataFrame:
    return frontier.judged(_frontier(spark), robots_rules(spark, base)).select("url", "domain", "allowed_to_crawl")


@query("frontier_new_urls", f"SELECT DISTINCT dst_url AS url, 'pending' AS status FROM ({_LINKS}) WHERE dst_url <> regexp_replace(src_url, '#.*$', '') AND dst_url NOT IN (SELECT url FROM pages)")
def frontier_new_urls(spark: SparkSession, base: str) -> DataFrame:
    known = tables.pages(spark, base).select("url", F.lit(frontier.DONE).alias("status"))
    return frontier.new_urls(pages.links(tables.pages(spark, base)).select(F.col("dst_url").alias("url")), known)


@query("frontier_mark_done", "SELECT url, CASE WHEN page_id % 3 = 0 THEN 'done' ELSE 'pending' END AS status FROM pages")
def frontier_mark_done(spark: SparkSession, base: str) -> DataFrame:
    every = tables.pages(spark, base)
    return frontier.mark_done(every.select("url", F.lit(frontier.PENDING).alias("status")), every.where("page_id % 3 = 0").select("url"))


_AT = "floor(epoch(ts))::BIGINT"


def _events(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").select(F.col("user_id").alias("domain"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("limited"))


@query("politeness_schedule", f"""
SELECT event_id, number, number * 3600 + max({_AT} - 3600 * number) OVER (PARTITION BY user_id ORDER BY number) AS start_s
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT, event_id)::INT AS number FROM events)
""")  # fmt: skip
def politeness_schedule(spark: SparkSession, base: str) -> DataFrame:
    arrivals = _events(spark, base).withColumnRenamed("at", "arrival_s").withColumn("crawl_delay_s", F.lit(3600).cast("long"))
    return frontier.schedule(arrivals).select(F.col("seq").alias("event_id"), "number", "start_s")


_ERRORS = f"""
SELECT user_id, event_id, at_s, limited, count(*) FILTER (WHERE limited) OVER (PARTITION BY user_id, run ORDER BY at_s, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS errors FROM (
  SELECT *, count(*) FILTER (WHERE NOT limited) OVER (PARTITION BY user_id ORDER BY at_s, event_id ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT user_id, event_id, {_AT} AS at_s, event_type = 'error' AS limited FROM events))
"""


@query("consecutive_errors", f"SELECT event_id, errors, CASE WHEN limited THEN least(300, 2 * pow(2, least(errors - 1, 9)))::BIGINT END AS backoff_s FROM ({_ERRORS})")
def consecutive_errors(spark: SparkSession, base: str) -> DataFrame:
    return frontier.consecutive_errors(_events(spark, base)).select(F.col("seq").alias("event_id"), "errors", "backoff_s")


@query("backoff_seconds", "SELECT d::BIGINT AS delay_s, e::BIGINT AS errors, least(300, greatest(1, d) * pow(2, e))::BIGINT AS backoff_s FROM range(0, 6) AS t(d), range(0, 40) AS u(e)")
def backoff_seconds(spark: SparkSession, base: str) -> DataFrame:
    rows = spark.range(6).select(F.col("id").alias("delay_s"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("errors"))
    return rows.select("delay_s", "errors", robots.backoff(F.col("delay_s"), F.col("errors")).alias("backoff_s"))


@query("crawl_round", f"""
WITH l AS (SELECT DISTINCT dst_url AS url FROM ({_LINKS}) WHERE dst_url <> regexp_replace(src_url, '#.*$', '') AND dst_url NOT IN (SELECT url FROM pages))
SELECT url, 'done' AS status FROM pages UNION ALL SELECT url, 'pending' FROM l
""")  # fmt: skip
def crawl_round(spark: SparkSession, base: str) -> DataFrame:
    """The frontier after one round over all pages, replayed from the table; no rules forbid any."""
    stored = tables.pages(spark, base)
    rules = spark.createDataFrame([], "domain string, disallowed array<string>, allowed array<string>, crawl_delay_s long")
    _, after = crawl.step(stored.select("url", F.lit(frontier.PENDING).alias("status")), rules, lambda urls_: crawl.replay(urls_, stored))
    return after


# ---- corpus analytics


@query("docs_by_lang_source", "SELECT lang, source, count(*)::BIGINT AS docs, sum(n_chars)::BIGINT AS chars, max(n_chars)::BIGINT AS longest FROM documents GROUP BY lang, source")
def docs_by_lang_source(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


@query("dup_documents", "SELECT sha256(text) AS digest, count(*)::BIGINT AS copies, min(doc_id)::BIGINT AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_documents(spark: SparkSession, base: str) -> DataFrame:
    digests = table(spark, base, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return digests.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


# ---- embedding, search and query parsing


@query("blob_join", "SELECT page_id, url, octet_length(encode(html))::INT AS bytes FROM pages")
def blob_join(spark: SparkSession, base: str) -> DataFrame:
    """Pages stored as blobs, and their messages joined with the blobs again; an address may have several pages."""
    every = tables.pages(spark, base)
    messages = tables.store_blobs(every, path := scratch(spark, "blobs"), "page_id")
    back = tables.with_content(messages, spark.read.parquet(path)).unionByName(every.where(F.col("content").isNull()))
    return back.select("page_id", "url", F.octet_length("content").alias("bytes"))


@query("vector_rows", "SELECT vec_id, 0 AS chunk_id, 'chunk ' || vec_id AS text, len(embedding)::INT AS dimensions FROM embeddings")
def vector_rows(spark: SparkSession, base: str) -> DataFrame:
    """Messages with parallel chunks and embeddings, zipped to rows."""
    stored = table(spark, base, "embeddings")
    messages = stored.select(F.col("vec_id").cast("string").alias("url"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("description"), F.array(F.concat(F.lit("chunk "), F.col("vec_id"))).alias("chunks"), F.array("embedding").alias("embeddings"))
    rows, _ = vectors.rows_of(messages, 64)
    return rows.select(F.col("url").cast("long").alias("vec_id"), "chunk_id", "text", F.size("vector").alias("dimensions"))


_OVERLAP = f"len(list_intersect(list_distinct(string_split(lower({_CLEAN}), ' ')), list_distinct(string_split(lower(asked), ' '))))::DOUBLE / len(list_distinct(string_split(lower(asked), ' ')))"


@query("search_rerank", f"""
WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), top AS (
  SELECT v.vec_id, {_DISTANCE} AS d FROM embeddings v, q WHERE v.vec_id IN (SELECT doc_id FROM documents) ORDER BY d, v.vec_id LIMIT 20)
SELECT doc_id, round(d, 6) AS vector_distance, round({_OVERLAP}, 6) AS score FROM top JOIN documents ON vec_id = doc_id, (SELECT 'the and of in' AS asked)
""")  # fmt: skip
def search_rerank(spark: SparkSession, base: str) -> DataFrame:
    """The 20 nearest documents, scored against a phrase."""
    documents = table(spark, base, "documents")
    stored = table(spark, base, "embeddings").join(documents.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    top = vectors.nearest(stored, _vector_zero(spark, base), 20, ["vec_id"], "embedding")
    found = documents.join(F.broadcast(top), F.col("doc_id") == F.col("vec_id"))  # 20 rows
    return found.select("doc_id", F.round("vector_distance", 6).alias("vector_distance"), F.round(search.overlap(F.lit("the and of in"), F.col("text")), 6).alias("score"))


@query("chunk_embed_search")
def chunk_embed_search(spark: SparkSession, base: str) -> DataFrame:
    """Pages parsed, chunked, embedded without a model, searched and reranked."""
    made = cut(vectors.embed(pages.chunks(pages.parse(tables.pages(spark, base)))), "vectors")
    return search.search(made, "the and of in", 10)


_STOPS = "[" + ", ".join(f"'{w}'" for w in stem.ENGLISH) + "]"
_TOKENS = r"list_filter(string_split(trim(regexp_replace(query, '[\s\p{Z}]+', ' ', 'g'), ' '), ' '), lambda t: t <> '')"


@query("parse_query", f"""
SELECT query, array_to_string(list_filter({_TOKENS}, lambda t: NOT starts_with(t, 'site:')), ' ') AS original_text,
  substring(list_filter({_TOKENS}, lambda t: starts_with(t, 'site:'))[-1], 6) AS site_filter,
  array_to_string(list_filter(list_transform(list_filter({_TOKENS}, lambda t: NOT starts_with(t, 'site:')), lambda t: lower(t)), lambda t: NOT list_contains({_STOPS}, t)), ' ') AS kept
FROM (VALUES {', '.join(f"('{q}')" for q, _ in fixtures.PHRASES)}) AS t(query)
""")  # fmt: skip
def parse_query(spark: SparkSession, base: str) -> DataFrame:
    rows = spark.createDataFrame(fixtures.PHRASES, "query string, language string")
    return search.parse_query(rows).select("query", "original_text", "site_filter", F.array_join("kept_words", " ").alias("kept"))


@query("parse_query_stems", "SELECT * FROM (VALUES ('Running foxes site:example.com the FOREST', 'run fox forest'), ('site:a.example  site:b.example', ''), ('the and of', ''), ('nationally  hopping cats', 'nation hop cat')) AS t(query, processed_text)")
def parse_query_stems(spark: SparkSession, base: str) -> DataFrame:
    rows = spark.createDataFrame(fixtures.PHRASES, "query string, language string")
    return search.parse_query(rows).select("query", "processed_text")


# ---- streams


@query("stream_ingest")
def stream_ingest(spark: SparkSession, base: str) -> DataFrame:
    """Document messages of all pages through the ingest stream, and the chunks it stored."""
    root = scratch(spark, "stream")
    messages = tables.store_blobs(tables.pages(spark, base), f"{root}/blobs")
    tables.to_messages(messages).write.text(f"{root}/messages")
    streaming.ingest(spark, f"{root}/messages", f"{root}/blobs", f"{root}/chunks", f"{root}/dead", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/chunks").select("url", "title", "chunk_id", "text")


@query("vector_stream", "SELECT vec_id, 0 AS chunk_id, 'chunk ' || vec_id AS text, len(embedding)::INT AS dimensions, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings")
def vector_stream(spark: SparkSession, base: str) -> DataFrame:
    """Stored vectors as messages through the vector stream, and the rows it stored."""
    root, none = scratch(spark, "vectors"), F.lit(None).cast("string")
    stored = table(spark, base, "embeddings")
    rows = stored.select(F.col("vec_id").cast("string").alias("url"), none.alias("title"), none.alias("description"), F.lit(0).alias("chunk_id"), F.concat(F.lit("chunk "), F.col("vec_id")).alias("text"), F.col("embedding").alias("vector"))
    tables.to_messages(vectors.messages_of(rows)).write.text(f"{root}/messages")
    streaming.index(spark, f"{root}/messages", f"{root}/rows", f"{root}/dead", f"{root}/checkpoint", 64)
    return spark.read.parquet(f"{root}/rows").select(F.col("url").cast("long").alias("vec_id"), "chunk_id", "text", F.size("vector").alias("dimensions"), F.round(F.col("vector")[0].cast("double"), 5).alias("first"))


_BLOCKED = "(SELECT user_id, max(floor(epoch(ts))::BIGINT) AS until FROM events GROUP BY user_id)"


@query("backoff_gate", f"""
SELECT user_id || '.example' AS domain, 'https://' || user_id || '.example/' AS url, greatest(until - 1700000000, 0)::BIGINT AS start_s FROM {_BLOCKED}
""")  # fmt: skip
def backoff_gate(spark: SparkSession, base: str) -> DataFrame:
    """When an address of each blocked domain may be fetched."""
    last = _events(spark, base).groupBy("domain").agg(F.max("at").alias("blocked_until"))
    blocked = last.select(F.concat(F.col("domain"), F.lit(".example")).alias("domain"), "blocked_until")
    known = blocked.select(F.concat(F.lit("https://"), F.col("domain"), F.lit("/")).alias("url"), F.lit(frontier.PENDING).alias("status"))
    rules = spark.createDataFrame([], "domain string, disallowed array<string>, allowed array<string>, crawl_delay_s long")
    return frontier.round_of(known, rules, blocked, 1_700_000_000)[0].select("domain", "url", "start_s")


@query("stream_frontier", f"""
SELECT user_id AS domain, count(*)::BIGINT AS fetches, arg_max(errors, row(at_s, event_id))::BIGINT AS errors,
  arg_max(CASE WHEN limited THEN at_s + least(300, 2 * pow(2, least(errors - 1, 9)))::BIGINT ELSE 0 END, row(at_s, event_id))::BIGINT AS blocked_until
FROM ({_ERRORS}) GROUP BY user_id
""")  # fmt: skip
def stream_frontier(spark: SparkSession, base: str) -> DataFrame:
    """Crawl states by domain from the stream of outcomes: each domain's last update."""
    root = scratch(spark, "states")
    _events(spark, base).write.parquet(f"{root}/outcomes")
    outcomes = spark.readStream.schema("domain long, at long, seq long, limited boolean").parquet(f"{root}/outcomes")
    states = streaming.crawl_states(outcomes)
    save = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/states/{number}")
    states.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("batch")))
    return spark.read.parquet(f"{root}/states/*").withColumn("place", last).where("place = 1").drop("place", "batch")
