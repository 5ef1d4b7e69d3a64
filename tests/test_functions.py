from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodespan.config import Settings
from lodespan.functions import extract, stem, text, urls
from lodespan.plans import fixtures


def test_sentences():
    assert text.sentences("Rain fell! Did the river rise? It did. nobody came") == ["Rain fell!", "Did the river rise?", "It did. nobody came"]
    found = text.sentences("Prof. Okoro measured 2.75 metres near the N.Z. coast. Was it deep? Some, i.e. three divers, thought so! Others left")
    assert found == ["Prof.", "Okoro measured 2.75 metres near the N.Z. coast.", "Was it deep?", "Some, i.e. three divers, thought so!", "Others left"]
    assert text.sentences("") == [] and text.sentences("?! ... \n") == []


def test_chunks():
    assert text.chunk("Ash. Elm. Oak. Yew.", 4, 1) == ["Ash. Elm. Oak. Yew."]
    parts = ["Boats left the bay early.", "Gulls followed.", "Fog came in from the open sea.", "Nobody saw land.", "A bell rang twice."]
    assert text.chunk(" ".join(parts), 10, 1) == [" ".join(parts[a:b]) for a, b in ((0, 2), (1, 3), (2, 4), (3, 5))]
    assert text.chunk("", 8, 1) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 50), st.integers(0, 5))
def test_chunk_spans_cover_everything(words, most, overlap):
    spans = text.chunk_spans(words, most, overlap)
    assert sorted({i for a, b in spans for i in range(a, b)}) == list(range(len(words)))
    for a, b in spans:
        assert b - a == 1 or sum(words[a:b]) <= most
        assert b == len(words) or sum(words[a : b + 1]) > most
    for (a, b), (c, _) in zip(spans, spans[1:]):
        assert c == max(a + 1, b - overlap)


def test_text_expressions(spark):
    row = spark.createDataFrame([("\t Salt,\r\n \u00a0pepper \n\t and   thyme  ", "x" * 161, "é" * 160, bytearray(b"a\xffb"))], "a string, b string, c string, d binary")
    got = row.select(text.clean(F.col("a")), text.word_count(F.col("a")), text.word_count(F.lit(" \n")), text.snippet(F.col("b")), text.snippet(F.col("c")), text.utf8(F.col("d"))).first()
    assert tuple(got) == ("Salt, pepper and thyme", 4, 0, "x" * 160 + "...", "é" * 160, "a�b")


@pytest.mark.parametrize(
    ("ref", "address"),
    [
        ("../a b?x='1'#f", "https://example.com/a%20b?x=%271%27"),
        ("//H.com:443/x", "https://h.com/x"),
        ("?q", "https://example.com/b/c?q"),
        ("", "https://example.com/b/c?d"),
        ("#part", "https://example.com/b/c?d"),
        ("/für", "https://example.com/f%C3%BCr"),
        ("\\x\\y", "https://example.com/x/y"),
        ("https://ex%41mple.COM:80/", "https://example.com:80/"),
        ("https:foo", "https://example.com/b/foo"),
        ("javascript:void(0)", None),
        ("mailto:a@b.c", None),
        ("http://a b/", None),
        ("http://x:99999/", None),
    ],
)
def test_resolve(ref, address):
    assert urls.resolve("https://example.com/b/c?d#e", ref) == address


def test_resolve_needs_a_base():
    assert urls.resolve("not a url", "/a") is None and urls.normal("HTTP://A.b:80") == "http://a.b/"


def test_url_expressions(spark):
    rows = spark.createDataFrame([("https://A.example:8080/x/My_file-1.pdf?q#f",), ("no url",), (None,)], "u string")
    got = [tuple(r) for r in rows.select(urls.host(F.col("u")), urls.robots_url(F.col("u")), urls.fallback_title(F.col("u")), urls.shard(urls.host(F.col("u")), 4).between(0, 3)).collect()]
    assert got[0] == ("a.example", "https://a.example/robots.txt", "My file 1", True)
    assert got[1][0] is None and got[2][0] is None


def test_html():
    page = extract.parse_html("<html><head><title> a &amp; b </title><title>no</title><meta name='description' content=' d '></head><body><p>x<b>a</b>b<!--c-->d<script>var t='</p>';</script>")
    assert (page.title, page.description) == ("a &amp; b", "d") and page.text == " a & b  no x a b d var t='</p>';"
    found = extract.links(b'<p><a href="../maps/">Maps</a> <a href="http://harbour.test/tides?d=2">Tides</a> <a href="tel:+123">Call</a> <a href="ftp://files.test/x">F</a> <a href="#top">Up</a> <a name="x">no address</a>', "text/html", "https://island.test/news/today")
    assert found == ["http://harbour.test/tides?d=2", "https://island.test/maps/"]
    assert extract.links(b'<a href="/x">', "text/html", "bad") == []


def test_html_as_written():
    content = "<title> a &am </title><meta name='description' content='R&amp;D &amp'><p>&lt;&#233;&eacute;&eacute &ampx; &nosuch; &amp<script>a &amp;& b</script>"
    page = extract.parse_html(content, written=True)
    assert (page.title, page.description) == ("a &am", "R&D &amp") and page.text == " a &am  <éé&eacute &ampx; &nosuch; &amp a &amp;& b"
    page = extract.parse_html(content)
    assert (page.title, page.description) == ("a &amp;am", "R&D &") and page.text == " a &am  <ééé &x; &nosuch; & a &amp;& b"


def test_xml():
    assert extract.links(fixtures.SITEMAP.encode(), "application/xml", "https://island.test/sitemap.xml") == ["https://island.test/ferries", "https://island.test/tides/today"]
    feed = extract.parse(fixtures.FEED.encode(), "text/xml", "https://example.com/feed")
    assert (feed.title, feed.description) == ("News & more", "All") and "<b>First</b>" in feed.text
    nested = extract.parse_xml("<a><title>x<b>y</b>z</title><summary>s</summary></c><late>no</late>")
    assert (nested.title, nested.text) == ("x", "x y z s")
    assert extract.xml_links("<f><link href='/a'></link><link href='/b'/></f>", "https://e.com/") == ["https://e.com/a"]


def test_pdf():
    assert extract.links(fixtures.PDF, "application/pdf", "https://example.com/a.pdf") == ["https://example.com/from-pdf"]
    page = extract.parse(fixtures.PDF, "application/pdf", "https://example.com/a_short-paper.pdf")
    assert (page.text, page.title, page.description) == ("Hello from a page", "a short paper", "A (short) paper")
    with pytest.raises(extract.BadPdf):
        extract.parse(b"no", "application/pdf", "https://example.com/a.pdf")


@pytest.mark.parametrize(("word", "stem_"), [("running", "run"), ("hopping", "hop"), ("nationally", "nation"), ("generously", "generous"), ("ties", "tie"), ("cries", "cri"), ("happy", "happi"), ("agreed", "agre"), ("relational", "relat"), ("skies", "sky"), ("by", "by")])
def test_english_stems(word, stem_):
    assert stem.english(word) == stem_


def test_settings():
    assert Settings.from_env({"LODESPAN_SHARDS": "4", "OTHER": "x"}).shards == 4 and Settings().crawl_delay_s == 2
    assert Settings.shard_of_host("crawler-3") == 3 and Settings.shard_of_host("host") == 0


@pytest.mark.parametrize("pdf", [fixtures.PDF_TWO_STREAMS, fixtures.PDF_TWO_STREAMS.replace(b"[5 0 R 7 0 R]", b"8 0 R").replace(b"trailer", b"8 0 obj\n[5 0 R 7 0 R]\nendobj\ntrailer")])
def test_pdf_content_of_several_streams(pdf):
    assert extract.parse(pdf, "application/pdf", "https://example.com/a.pdf").text == "Hello from a page in two streams"
